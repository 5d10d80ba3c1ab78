"""Queries that write a table with a sink and read it back with a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.plans.curate import t
from pairmill.plans.places import folder
from pairmill.plans.registry import query
from pairmill.sources import readers, writers

_NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("k01_parquet_by_folder", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet_by_folder(spark, sf):
    path = folder(spark, "k01")
    writers.parquet(t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, by=["n_regionkey"])
    return spark.read.schema(_NATION).parquet(path)


@query("k02_append_new_rows", "SELECT c_custkey, c_name FROM customer")
def append_new_rows(spark, sf):
    path = folder(spark, "k02")
    rows = t(spark, sf, "customer").select("c_custkey", "c_name")
    for part in (rows.where("c_custkey % 3 = 0"), rows, rows):  # what is there already isn't written again
        writers.append_new(part, path, ["c_custkey"])
    return spark.read.schema(rows.schema).parquet(path)


@query("s02_csv", "SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def csv_rows(spark, sf):
    path = folder(spark, "s02")
    writers.csv(t(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice"), path)
    return readers.csv(spark, path, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double")


@query("k08_csv_with_texts", "SELECT conv_id, turn, text FROM conversations WHERE text <> ''")
def csv_with_texts(spark, sf):
    path = folder(spark, "k08")
    writers.csv(t(spark, sf, "conversations").select("conv_id", "turn", "text").where("text <> ''"), path)
    return readers.csv(spark, path, "conv_id long, turn long, text string")


@query("s04_csv_other_separator", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_other_separator(spark, sf):
    path = folder(spark, "s04")
    t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True, sep="༜")
    return readers.csv(spark, path, _NATION, sep="༜")


@query("s05_json_lines", "SELECT doc_id, text, lang FROM documents")
def json_lines(spark, sf):
    path = folder(spark, "s05")
    writers.jsonl(t(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return readers.jsonl(spark, path, "doc_id long, text string, lang string")


@query("s06_zipped_json_lines", "SELECT conv_id, turn, role FROM conversations")
def zipped_json_lines(spark, sf):
    path = folder(spark, "s06")
    t(spark, sf, "conversations").select("conv_id", "turn", "role").write.option("compression", "gzip").json(path)
    return readers.jsonl(spark, f"{path}/*.json.gz", "conv_id long, turn long, role string")


def _judged(spark, sf):
    """Conversations' turns judged against their number, as benchmark judgements."""
    rows = t(spark, sf, "conversations")
    return rows.select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("query-id"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("corpus-id"), F.pmod("turn", F.lit(3)).cast("int").alias("score"), "role")


_JUDGED = "SELECT 'q' || conv_id AS \"query-id\", 'c' || conv_id || '_' || turn AS \"corpus-id\", (turn % 3)::INTEGER AS score, role, conv_id FROM conversations"


@query("s07_judgement_file", f'SELECT "query-id", "corpus-id", score FROM ({_JUDGED})')
def judgement_file(spark, sf):
    path = folder(spark, "s07")
    writers.qrels(_judged(spark, sf).drop("role"), path)
    return readers.qrels(spark, path)


@query("k05_judgements_by_folder", f'SELECT "query-id", "corpus-id", score, role FROM ({_JUDGED})')
def judgements_by_folder(spark, sf):
    path = folder(spark, "k05")
    writers.qrels(_judged(spark, sf), path, by=["role"])
    return spark.read.csv(path, schema="`query-id` string, `corpus-id` string, score int, role string", sep="\t", header=True)


@query("k06_file_names", "SELECT DISTINCT p_type, replace(lower(trim(p_type)), ' ', '_') AS file FROM part")
def file_names(spark, sf):
    return t(spark, sf, "part").select("p_type", writers.file_name(F.col("p_type")).alias("file")).distinct()


@query("s08_benchmark_rows", f"SELECT 'text of ' || any_value(conv_id) AS query, count(*) AS n_relevant, sum(score)::BIGINT AS total FROM ({_JUDGED}) GROUP BY \"query-id\"")
def benchmark_rows(spark, sf):
    path = folder(spark, "s08")
    writers.qrels(_judged(spark, sf).drop("role"), f"{path}/qrels")
    ids = t(spark, sf, "conversations").select("conv_id").distinct()
    writers.jsonl(ids.select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("_id"), F.concat(F.lit("text of "), F.col("conv_id").cast("string")).alias("text")), f"{path}/queries")
    rows = readers.benchmark(readers.jsonl(spark, f"{path}/queries", "_id string, text string"), readers.qrels(spark, f"{path}/qrels"))
    return rows.select("query", F.size("relevant").cast("long").alias("n_relevant"), F.aggregate("relevant", F.lit(0).cast("long"), lambda a, x: a + x["score"]).alias("total"))


@query("s21_first_file_there", "SELECT item_id, text FROM benchmark")
def first_file_there(spark, sf):
    path = folder(spark, "s21")
    writers.jsonl(t(spark, sf, "benchmark").select("item_id", "text"), f"{path}/second")
    return readers.first_that_exists(spark, [f"{path}/first", f"{path}/second"], "item_id long, text string")


@query("k12_predictions", "SELECT conv_id AS query_id, turn AS corpus_id, length(text)::DOUBLE AS score FROM conversations")
def predictions(spark, sf):
    path = folder(spark, "k12")
    writers.predictions(t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("corpus_id"), F.char_length("text").cast("double").alias("score")), path)
    rows = readers.jsonl(spark, path, "query_id long, results array<struct<corpus_id:long,score:double>>")
    return rows.select("query_id", F.inline("results"))


@query("u03_all_batches", "SELECT event_id, event_type FROM events")
def all_batches(spark, sf):
    path = folder(spark, "u03")
    rows = t(spark, sf, "events").select("event_id", "event_type")
    for k in range(3):
        rows.where(F.pmod("event_id", F.lit(3)) == k).write.parquet(f"{path}/batch_{k}")
    return spark.read.schema(rows.schema).parquet(f"{path}/batch_*")


@query("k10_metrics_merged", "SELECT 'm' || n_regionkey AS model, 'r' || n_nationkey AS metric, (n_nationkey * CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS value FROM nation")
def metrics_merged(spark, sf):
    path = folder(spark, "k10")
    rows = t(spark, sf, "nation").select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model"), F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("metric"), F.col("n_nationkey").cast("long").alias("value"))
    writers.jsonl(rows, f"{path}/old")
    old = readers.jsonl(spark, f"{path}/old", "model string, metric string, value long")
    new = rows.where("value % 2 = 0").withColumn("value", F.col("value") * 2)
    writers.jsonl(writers.latest(old, new, ["model", "metric"]), f"{path}/new")
    return readers.jsonl(spark, f"{path}/new", "model string, metric string, value long")
