"""Queries: an evaluation set built from the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.operators import evaluation, evalsets
from pairmill.plans.benchmarks import _KEYS, results
from pairmill.plans.curate import t
from pairmill.plans.places import folder
from pairmill.plans.registry import query

_ROWS = """WITH r AS (SELECT 'set' || (u.conv_id % 3) AS name, u.conv_id * 100000 + u.turn * 10 + CASE WHEN x.copy THEN 1 ELSE 0 END AS o, u.text AS anchor, CASE WHEN x.copy THEN a.role ELSE a.text END AS positive
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1, (SELECT unnest([false, true]) AS copy) x WHERE u.role = 'user'),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) - 1 AS id FROM r), m AS (SELECT * FROM n WHERE id < 200)"""


def _set(spark, sf):
    """Turns and the turns that follow them, and each turn once more with a positive that many rows share."""
    c = t(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("anchor"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "text", "role")
    rows = u.join(a, ["conv_id", "turn"]).withColumn("copy", F.explode(F.array(F.lit(False), F.lit(True))))
    o = F.col("conv_id") * 100000 + F.col("turn") * 10 + F.col("copy").cast("int")
    rows = rows.select(F.concat(F.lit("set"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("name"), o.alias("o"), "anchor", F.when(F.col("copy"), F.col("role")).otherwise(F.col("text")).alias("positive"))
    return evalsets.built(rows, "o", 200)


@query("r11_evaluation_set", f"{_ROWS} SELECT name || '_q_' || id AS qid, name || '_c_' || id AS cid, md5(anchor) AS query, md5(positive) AS text, count(*) OVER (PARTITION BY name, positive)::BIGINT AS r FROM m")
def evaluation_set(spark, sf):
    got = _set(spark, sf)
    corpus = got.corpus.select("name", "id", "cid", F.md5("text").alias("text"))
    rows = got.queries.select("name", "id", "qid", F.md5("text").alias("query")).join(corpus, ["name", "id"])
    return rows.join(evalsets.relevant(got).drop("qid"), ["name", "id"]).select("qid", "cid", "query", "text", "r")


@query("r08_pairs_of_a_batch", f"{_ROWS} SELECT name, id // 32 AS batch_id, count(*)::BIGINT AS rows, min(id)::BIGINT AS first FROM m GROUP BY 1, 2")
def pairs_of_a_batch(spark, sf):
    """Batches for the loss, in the order of the rows."""
    return _set(spark, sf).pairs.groupBy("name", "batch_id").agg(F.count("*").alias("rows"), F.min("i").alias("first"))


@query("c24_cosine_keys", f"{_KEYS} SELECT dataset || '_' || string_split(key, '__')[2] AS dataset, string_split(string_split(string_split(key, '__')[-1], '@')[1], '_')[-1] AS metric, string_split(key, '@')[2]::INTEGER AS k, round(value, 6) AS value FROM keys WHERE model = 'cosine' AND dataset = 'nano'")
def cosine_keys(spark, sf):
    """Keys of the form ``dataset_cosine_metric@k``; others are skipped."""
    path = folder(spark, "c24")
    rows = evaluation.keyed(results(spark, sf)).where("dataset = 'nano'")
    old = F.concat(F.lit("nano_"), F.get(F.split("key", "__"), F.lit(1)), F.regexp_extract("key", r"__evaluator(_[a-z]+_[a-z]+@\d+)$", 1))
    rows.select(old.alias("key"), "value").write.json(path)
    read = spark.read.schema("key string, value double").json(path)
    form = r"^(.*?)_cosine_([a-zA-Z]+)@(\d+)$"
    part = lambda n: F.regexp_extract("key", form, n)
    return read.where(F.col("key").rlike(form)).select(part(1).alias("dataset"), part(2).alias("metric"), part(3).cast("int").alias("k"), F.round("value", 6).alias("value"))
