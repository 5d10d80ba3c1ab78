"""Exact retrieval and its metrics as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions import vectors

#: Rows of a side that is sent to all tasks; its size is checked against it.
SENT_ROWS = 100_000


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df marked to be sent to all tasks where it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grows(df: DataFrame) -> DataFrame:
    """df marked to be joined by a shuffle: a side that grows with the input isn't gathered in the driver while it is still small."""
    return df.hint("merge")


def top_k(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query; ties to the larger id. The window's limit is pushed before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("corpus_id").desc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int], keys: list[str] = [], sets: list[str] = []) -> DataFrame:
    """One row a k: accuracy, precision, recall, MRR, nDCG, MAP over the queries with relevant rows.

    ranked: query_id, corpus_id, rank; relevant: query_id, corpus_id; keys:
    further columns of ranked that tell runs apart; sets: columns of both that
    tell data sets apart.
    """
    relevant = relevant.select(*sets, "query_id", "corpus_id").distinct()
    size = relevant.groupBy(*sets, "query_id").agg(F.count("*").alias("r"))
    runs = ranked.select(*keys).distinct() if keys else None
    asked = size.crossJoin(sent(runs)) if keys else size
    hits = ranked.join(relevant, [*sets, "query_id", "corpus_id"])
    return measured(hits.select(*keys, *sets, "query_id", "rank"), asked, ks, [*keys, *sets])


def measured(hits: DataFrame, asked: DataFrame, ks: list[int], keys: list[str] = []) -> DataFrame:
    """keys and k with their metrics. hits: keys, query_id and rank of each relevant row found; asked: keys, query_id and r (how many are relevant) of every query."""
    run = Window.partitionBy(*keys, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.select(*keys, "query_id", "rank", F.count("*").over(run).alias("h"))
    each = grows(asked).join(grows(hits.groupBy(*keys, "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "h"))).alias("hits"))), [*keys, "query_id"], "left")
    each = each.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    got = F.filter(F.coalesce("hits", F.array().cast("array<struct<rank:int,h:bigint>>")), lambda x: x["rank"] <= F.col("k"))
    each = each.withColumn("got", got).withColumn("n", F.size("got"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    gain = total(F.transform("got", lambda x: 1 / F.log2(x["rank"] + 1.0)))
    ideal = total(F.transform(F.sequence(F.lit(1), F.least("k", "r").cast("int")), lambda i: 1 / F.log2(i + 1.0)))
    mean_precision = total(F.transform("got", lambda x: x["h"] / x["rank"])) / F.least("k", "r")
    of: dict[str, Column] = {
        "accuracy": (F.col("n") > 0).cast("double"),
        "precision": F.col("n") / F.col("k"),
        "recall": F.col("n") / F.col("r"),
        "mrr": F.coalesce(1 / F.try_element_at("got", F.lit(1))["rank"], F.lit(0.0)),
        "ndcg": gain / ideal,
        "map": mean_precision,
    }
    return each.groupBy(*keys, "k").agg(*[F.round(F.avg(c), 6).alias(m) for m, c in of.items()], F.count("*").alias("n_queries"))


def ranking_loss(pairs: DataFrame, scale: float = 20.0) -> DataFrame:
    """In-batch ranking loss: batch_id, rows, loss (mean cross-entropy of the anchor's own positive).

    pairs: batch_id, i, anchor, positive (vectors). Batches are of bounded size.
    """
    left = pairs.select("batch_id", "i", "anchor")
    right = pairs.select("batch_id", F.col("i").alias("j"), "positive")
    s = left.join(right, "batch_id").withColumn("s", vectors.cosine(F.col("anchor"), F.col("positive")) * scale)
    rows = s.groupBy("batch_id", "i").agg((F.log(F.sum(F.exp("s"))) - F.max(F.when(F.col("i") == F.col("j"), F.col("s")))).alias("loss"))
    return rows.groupBy("batch_id").agg(F.count("*").alias("rows"), F.round(F.avg("loss"), 6).alias("loss"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, corpus_id, score. docs: corpus_id, text; queries: query_id, text. Words between white space, lowered.

    A document's words are counted in its row, and only those that a query
    asks for leave it: their distinct words, where they are few enough, are
    sent to all tasks, else joined by word.
    """
    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    asked = queries.select("query_id", F.explode(F.array_distinct(split)).alias("word")).distinct()
    rows = docs.select("corpus_id", split.alias("words")).where(F.size("words") > 0)
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    each = rows.select("corpus_id", F.size("words").alias("size"), F.explode("words").alias("word"))
    tf = each.join(sent(asked.select("word").distinct()), "word", "left_semi").groupBy("corpus_id", "word", "size").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    hits = tf.join(asked.join(df, "word"), "word").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return hits.groupBy("query_id", "corpus_id").agg(F.round(F.sum(part), 6).alias("score"))


#: Pairs of a query and a word up to which the queries go to all tasks, queries of one product, cells of a block of documents.
ASKED, TOGETHER, CELLS = 50_000, 200, 1_000_000


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, digits: int = 4, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, corpus_id, score and rank of the k best documents of each query by bm25, scores rounded to digits.

    Texts are cut into words once: of each document the numbers of the words
    that some query asks for are written. Blocks of these are multiplied with
    the queries' words, and a task gives its k best of each query, so no pair
    of a query and a document is shuffled. Rows of one id are one document, and
    documents without an id aren't found. Queries of more than ASKED words are
    joined by word.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from pairmill.operators.blocks import Kept
    from pairmill.plans.places import folder

    spark = docs.sparkSession
    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    asked = queries.select("query_id", F.explode(split).alias("word")).distinct()
    if asked.limit(ASKED + 1).count() > ASKED:
        return top_k(bm25(docs, queries, k1, b).withColumn("score", F.round("score", digits)), k)
    pairs = asked.toArrow()  # at most ASKED rows
    names = pc.unique(pairs["word"].combine_chunks())
    ids = pc.unique(pairs["query_id"].combine_chunks())
    q = pc.index_in(pairs["query_id"].combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False)
    w = pc.index_in(pairs["word"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    known = spark.sparkContext.broadcast((names, ids, q, w))

    def found(batches):
        names = known.value[0].cast(pa.large_string())
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                words = pc.ascii_split_whitespace(part["text"].cast(pa.large_string()))
                owner, flat = pc.list_parent_indices(words).to_numpy(), words.flatten()
                full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
                size = np.bincount(owner[full], minlength=part.num_rows)
                hit = code >= 0
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[hit], minlength=part.num_rows))])
                codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[hit], pa.int32()))
                yield pa.record_batch({"corpus_id": part["corpus_id"], "size": pa.array(size, pa.int64()), "codes": codes})

    path = folder(spark, "bm25")
    rows = docs.where("text IS NOT NULL").select(F.col("corpus_id").cast("long").alias("corpus_id"), F.lower("text").alias("text"))
    rows = rows.mapInArrow(found, "corpus_id long, size long, codes array<int>").where("size > 0")
    rows.groupBy("corpus_id").agg(F.sum("size").alias("size"), F.flatten(F.collect_list("codes")).alias("codes")).write.parquet(path)  # a document's words
    rows = spark.read.schema("corpus_id long, size long, codes array<int>").parquet(path)
    n, mean = rows.agg(F.count("*"), F.avg("size")).first()
    df = np.zeros(len(names))
    for code, c in rows.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").count().collect():  # a row for each asked word
        df[code] = c
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    rounded = lambda x, d: np.floor(x * 10.0**d + 0.5) / 10.0**d  # noqa: E731  halves go up, as SQL rounds

    def scored(batches):
        names, ids, q, w = known.value
        sets = []
        for a in range(0, len(ids), TOGETHER):
            own = (q >= a) & (q < a + TOGETHER)
            words, at = np.unique(w[own], return_inverse=True)
            asks = np.zeros((len(words), min(TOGETHER, len(ids) - a)))
            asks[at, q[own] - a] = 1
            column = np.full(len(names), -1)
            column[words] = np.arange(len(words))
            sets.append((a, words, column, asks, Kept(asks.shape[1], k)))
        for batch in batches:
            lists, size, doc = batch["codes"], batch["size"].to_numpy(), batch["corpus_id"].to_numpy()
            offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            flat = flat[offs[0] : offs[-1]]
            base = offs - offs[0]
            for a, words, column, asks, best in sets:
                step = max(1, CELLS // len(words))
                for lo in range(0, batch.num_rows, step):
                    hi = min(lo + step, batch.num_rows)
                    at, row = column[flat[base[lo] : base[hi]]], owner[base[lo] : base[hi]] - lo
                    tf = np.bincount((row * len(words) + at)[at >= 0], minlength=(hi - lo) * len(words)).reshape(hi - lo, -1)
                    r, c = np.nonzero(tf)
                    weight = np.zeros(tf.shape)
                    times = tf[r, c]
                    weight[r, c] = idf[words[c]] * times * (k1 + 1) / (times + k1 * (1 - b + b * size[lo + r] / mean))
                    got = (weight @ asks).T
                    best.keep(doc[lo:hi], np.where(got > 0, rounded(rounded(got, 6), digits), -np.inf))
        for a, _, _, _, best in sets:
            if len(best.row):
                yield pa.record_batch({"query_id": ids.take(pa.array(a + best.row)), "corpus_id": pa.array(best.to), "score": pa.array(best.at)})

    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, corpus_id long, score double"
    return top_k(rows.where("corpus_id IS NOT NULL").mapInArrow(scored, schema), k)
