"""Evaluation sets from pairs: ids, relevance by equal text, triplets and loss pairs of many data sets at once.

Rows of a data set are numbered in order; the n-th gives query ``name_q_n`` and
corpus row ``name_c_n``. All corpus rows whose text equals a query's positive
are relevant to it. A text that stands in many rows would make relevance grow
with its square, so it is kept as a class: queries and corpus rows carry the
digest of the positive's text, and two of one data set with equal classes are
relevant to each other. ``ranked_metrics`` evaluates on classes; ``judgements``
spells them out where they are small.

Rows without an anchor or a positive are left out before they are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.operators import blocks, retrieval
from pairmill.operators.positions import running

#: k of evaluation during training.
TRAINING_KS = [1, 5, 10]


@dataclass
class EvaluationSet:
    queries: DataFrame  # name, id (number), qid, text, class
    corpus: DataFrame  # name, id, cid, text, class
    triplets: DataFrame  # name, anchor, positive, negative
    pairs: DataFrame  # name, batch_id, i, anchor, positive


def built(rows: DataFrame, order: str, most: int | None = None, batch: int = 32) -> EvaluationSet:
    """rows: name, anchor, positive, perhaps negative, and ``order``, a whole number that tells a data set's rows apart.

    most: rows of each data set, the first in order. Numbers come from runs of
    the order's values, so no task sees a data set.
    """
    if not {"anchor", "positive"} <= set(rows.columns):
        raise ValueError("rows need anchor and positive")
    sound = rows.where("anchor IS NOT NULL AND positive IS NOT NULL")
    own = running(sound.withColumn("one__", F.lit(1).cast("long")), ["name"], order, "one__", "id").drop("one__")
    own = own.where(F.col("id") < most) if most else own
    klass = F.sha2("positive", 256).alias("class")
    named = lambda kind: F.concat_ws(f"_{kind}_", "name", F.col("id").cast("string"))
    queries = own.select("name", "id", named("q").alias("qid"), F.col("anchor").alias("text"), klass)
    corpus = own.select("name", "id", named("c").alias("cid"), F.col("positive").alias("text"), klass)
    third = F.col("negative") if "negative" in rows.columns else F.lit(None).cast("string")
    triplets = own.select("name", "anchor", "positive", third.alias("negative")).where("negative IS NOT NULL")
    pairs = own.select("name", F.floor(F.col("id") / batch).alias("batch_id"), F.col("id").alias("i"), "anchor", "positive")
    return EvaluationSet(queries, corpus, triplets, pairs)


def relevant(set_: EvaluationSet) -> DataFrame:
    """name, id, qid and r: how many corpus rows are relevant to each query."""
    size = set_.corpus.groupBy("name", "class").agg(F.count("*").alias("r"))
    return set_.queries.join(size, ["name", "class"]).select("name", "id", "qid", "r")


def judgements(set_: EvaluationSet, most: int = 1_000) -> DataFrame:
    """qid, cid of all relevant pairs; a class of over ``most`` rows is an error, as its pairs are the square of them."""
    size = set_.corpus.groupBy("name", "class").agg(F.count("*").alias("n__"))
    checked = F.when(F.col("n__") > most, F.raise_error(F.lit(f"a text stands in over {most} rows: evaluate on classes"))).otherwise(F.col("class"))
    small = size.select("name", checked.alias("class"))
    left = set_.queries.select("name", "class", "qid").join(small, ["name", "class"])
    return left.join(set_.corpus.select("name", "class", "cid"), ["name", "class"]).select("qid", "cid")


def ranked_metrics(set_: EvaluationSet, query_vectors: DataFrame, corpus_vectors: DataFrame, score: str = "cosine", ks: list[int] = TRAINING_KS) -> DataFrame:
    """name, k and the metrics. query_vectors, corpus_vectors: name, id and v."""
    q = query_vectors.select("name", F.col("id").alias("query_id"), F.col("v").alias("qv"))
    c = corpus_vectors.select("name", F.col("id").alias("corpus_id"), F.col("v").alias("cv"))
    top = blocks.top_k(q, c, score, max(ks), by=["name"])
    mine = set_.queries.select("name", F.col("id").alias("query_id"), "class")
    found = set_.corpus.select("name", F.col("id").alias("corpus_id"), "class")
    hits = top.join(found, ["name", "corpus_id"]).join(mine, ["name", "query_id", "class"]).select("name", "query_id", "rank")
    asked = relevant(set_).select("name", F.col("id").alias("query_id"), "r")
    return retrieval.measured(hits, asked, ks, ["name"])
