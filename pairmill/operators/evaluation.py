"""Evaluation of a registry of benchmarks in one plan.

A benchmark lies in a folder with ``corpus`` (corpus_id, cv), ``queries``
(query_id, qv) and ``qrels`` (query_id, corpus_id, score; tab-separated), each
perhaps split into folders ``subset=...``; judgements perhaps also into
``data_file=...``. The registry names the folders, and the keys dataset and
subset go through search and metrics, so one plan evaluates all of them. A
corpus is searched once for each of its queries, whatever number of judgement
files asks for it.

Judgements of a score of 0 or less don't count; repeated ones count once. What
has no subset or file is called ``none``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.operators import blocks, retrieval
from pairmill.operators.retrieval import grows
from pairmill.plans.places import folder

METRICS = ("accuracy", "precision", "recall", "mrr", "ndcg", "map")
UNIT = ["dataset", "subset", "data_file"]
#: Ways to put the values of several sets together.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "least": F.min}


@dataclass(frozen=True)
class Benchmark:
    """A registered benchmark: where it lies and what it is split into."""

    name: str
    path: str
    subsets: tuple[str, ...] = ()
    data_files: tuple[str, ...] = ()


def units(spark: SparkSession, registry: list[Benchmark]) -> DataFrame:
    """dataset, subset, data_file, path: what is evaluated apart; a row for each."""
    rows = [(b.name, s, f, b.path) for b in registry for s in b.subsets or ("none",) for f in b.data_files or ("none",)]
    return spark.createDataFrame(rows, "dataset string, subset string, data_file string, path string")


def _part(spark: SparkSession, b: Benchmark, name: str, schema: str) -> DataFrame:
    """One part of a benchmark, with the unit's columns; a named subset or file that isn't there has no rows."""
    files = b.data_files if name == "qrels" else ()
    folders = "".join(f", {c} string" for c, has in (("subset", b.subsets), ("data_file", files)) if has)
    reader = spark.read.schema(schema + folders)
    rows = reader.csv(f"{b.path}/qrels", sep="\t", header=True) if name == "qrels" else reader.parquet(f"{b.path}/{name}")
    for c, wanted in (("subset", b.subsets), ("data_file", files)):
        rows = rows.where(F.col(c).isin(*wanted)) if wanted else rows.withColumn(c, F.lit("none"))
    return rows.withColumn("dataset", F.lit(b.name))


def loaded(spark: SparkSession, registry: list[Benchmark]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpora, queries, judgements) of all benchmarks."""
    out: list[DataFrame] = []
    for name, schema, own in (
        ("corpus", "corpus_id long, cv array<double>", ["corpus_id", "cv"]),
        ("queries", "query_id long, qv array<double>", ["query_id", "qv"]),
        ("qrels", "query_id long, corpus_id long, score int", ["data_file", "query_id", "corpus_id", "score"]),
    ):
        all_: DataFrame | None = None
        for b in registry:  # a plan's branch for each registered benchmark
            rows = _part(spark, b, name, schema).select("dataset", "subset", *own)
            all_ = rows if all_ is None else all_.unionByName(rows)
        out.append(all_)
    return tuple(out)


def pending(units_: DataFrame, done: DataFrame | None, scores: tuple[str, ...]) -> DataFrame:
    """The units and scores (a row for each) that the results lack."""
    every = units_.select(*UNIT).distinct().withColumn("score", F.explode(F.array(*map(F.lit, scores))))
    return every if done is None else every.join(done.select(*UNIT, "score").distinct(), [*UNIT, "score"], "left_anti")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read: every task sends the counters of its plan's whole lineage to the driver, so the lineage is cut."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evaluated(spark: SparkSession, registry: list[Benchmark], scores: tuple[str, ...] = ("cosine",), ks: list[int] = [1, 3, 5, 10], done: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """dataset, subset, data_file, score, k, the six metrics and n_queries of all that ``done`` (earlier results) lacks.

    A query without relevant rows isn't asked.
    """
    todo = retrieval.sent(_kept(pending(units(spark, registry), done, scores), "evaluated-todo"))  # the registry's rows
    corpus, queries, judged = loaded(spark, registry)
    judged = _kept(judged.where("score > 0").drop("score").distinct(), "evaluated-judged")
    set_ = ["dataset", "subset"]
    asked = _kept(judged.groupBy(*UNIT, "query_id").agg(F.count("*").alias("r")), "evaluated-asked")
    ranked: DataFrame | None = None
    for score in scores:
        own = todo.where(F.col("score") == score)
        q = _kept(queries.join(grows(asked.join(own, UNIT, "left_semi").select(*set_, "query_id").distinct()), [*set_, "query_id"], "left_semi"), "evaluated-queries")
        c = corpus.join(own.select(*set_).distinct(), set_, "left_semi")
        top = blocks.top_k(q, c, score, max(ks), by=set_, apart=apart).withColumn("score", F.lit(score)).select(*set_, "score", "query_id", "corpus_id", "rank")
        top = _kept(top, "evaluated-ranked")
        ranked = top if ranked is None else ranked.unionByName(top)
    hits = grows(ranked).join(grows(judged), [*set_, "query_id", "corpus_id"]).join(todo, [*UNIT, "score"], "left_semi")
    runs = asked.join(todo, UNIT)
    keys = [*UNIT, "score"]
    return retrieval.measured(hits.select(*keys, "query_id", "rank"), runs.select(*keys, "query_id", "r"), ks, keys)


def macro(results: DataFrame, how: str = "mean", by: tuple[str, ...] = ("dataset", "score", "k")) -> DataFrame:
    """Every metric put together over the units of a data set, each unit counting the same."""
    return results.groupBy(*by).agg(*[F.round(AGGREGATES[how](F.col(m)), 6).alias(m) for m in METRICS], F.sum("n_queries").alias("n_queries"))


def keyed(results: DataFrame) -> DataFrame:
    """model, key and value: each metric under ``dataset__subset__file__evaluator_score_metric@k``."""
    key = lambda m: F.concat(F.concat_ws("__", "dataset", "subset", "data_file", F.concat(F.lit("evaluator_"), "score")), F.lit(f"_{m}@"), F.col("k").cast("string"))
    pairs = F.explode(F.array(*[F.struct(key(m).alias("key"), F.col(m).alias("value")) for m in METRICS]))
    return results.select("dataset", F.col("score").alias("model"), pairs.alias("x")).select("dataset", "model", "x.*")


def parsed(keys: DataFrame) -> DataFrame:
    """keys (with a column key) and dataset, subset, data_file, metric, k; keys of another form are left out."""
    parts, last = F.split("key", "__"), F.split(F.element_at(F.split("key", "__"), -1), "@")
    sound = F.col("key").rlike(r"^[^@]+__[^@]+__[^@]+__[^@]+_[^@_]+@\d+$")
    return keys.where(sound).select("*", *[F.get(parts, F.lit(i)).alias(f"parsed_{c}") for i, c in enumerate(UNIT)], F.element_at(F.split(F.get(last, F.lit(0)), "_"), -1).alias("metric"), F.get(last, F.lit(1)).cast("int").alias("at_k"))


def dumped(results: DataFrame, path: str) -> None:
    """A folder of JSON lines for each data set: model and its metrics by key."""
    by = keyed(results).groupBy("dataset", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics"))  # a model's metrics of a data set
    by.write.mode("overwrite").partitionBy("dataset").json(path)


def undumped(spark: SparkSession, path: str) -> DataFrame:
    """model, key, value of all data sets' files."""
    rows = spark.read.schema("model string, metrics map<string,double>, dataset string").json(path)
    return rows.select("model", F.explode("metrics").alias("key", "value"))


def timed(results: Callable[[], DataFrame], n_queries: int) -> tuple[list, float, float]:
    """(rows, seconds in all, seconds a query) of an evaluation, run whole."""
    began = time.perf_counter()
    rows = results().collect()  # a row for each unit, score and k
    took = time.perf_counter() - began
    return rows, took, took / max(1, n_queries)
