"""Queries: streams that are split, enriched and resumed; texts embedded once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.operators import embedded
from pairmill.operators.providers import HashEmbedder, SentenceAsker
from pairmill.plans.curate import t
from pairmill.plans.places import folder
from pairmill.plans.registry import query
from pairmill.sources import writers
from pairmill.sources.readers import SourceSpec
from pairmill.streaming import incremental, splits


def _split(spark, sf, name, total_known):
    """events as a stream of files that come in three lots; the query stops and starts again between them."""
    path = folder(spark, name)
    rows = t(spark, sf, "events").select("event_id", "user_id", "event_type")
    total = rows.count()
    n_val, n_test = splits.sizes(total if total_known else None, 0.05, 0.1)
    cuts = [0, total // 50, total // 2, total]  # the first lot holds less than is taken
    for a, z in zip(cuts, cuts[1:]):
        lot = rows.where((F.col("event_id") >= a) & (F.col("event_id") < z) if z < total else F.col("event_id") >= a)
        lot.repartitionByRange(2, "event_id").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000).parquet(f"{path}/in")
        splits.take_and_skip(stream, "event_id", n_val, n_test, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("event_id long, user_id long, event_type string, split string").parquet(f"{path}/out/rows/*").select("event_id", "split")


_PLACES = "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, count(*) OVER () AS n FROM events)"


@query("i02_split_of_a_stream", f"{_PLACES} SELECT event_id, CASE WHEN place <= floor(n * 0.05 + 1e-9) THEN 'validation' WHEN place <= floor(n * 0.05 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'test' ELSE 'train' END AS split FROM p")
def split_of_a_stream(spark, sf):
    return _split(spark, sf, "i02", True)


@query("i03_stream_of_unknown_size", f"{_PLACES} SELECT event_id, CASE WHEN place <= 1000 THEN 'validation' WHEN place <= 2000 THEN 'test' ELSE 'train' END AS split FROM p")
def stream_of_unknown_size(spark, sf):
    return _split(spark, sf, "i03", False)


@query("i01_pairs_of_a_stream", "SELECT text AS anchor, role AS positive, 'talk' AS source, CASE WHEN b < 0.05 THEN 'test' WHEN b < 0.1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT text, role, ('0x' || substr(md5(text || '#42'), 1, 8))::BIGINT / 4294967296.0 AS b FROM conversations WHERE text <> '' AND role <> '')")
def pairs_of_a_stream(spark, sf):
    """Files of pairs as a stream: mapped, filtered, split and written, in two runs of one checkpoint."""
    path = folder(spark, "i01")
    rows = t(spark, sf, "conversations").select("text", "role", "turn")
    spec = SourceSpec("talk", f"{path}/in", "json", "text string, role string", anchor="text", positive="role")
    for late in (False, True):
        rows.where((F.col("turn") > 1) == F.lit(late)).drop("turn").repartition(2).write.mode("append").json(f"{path}/in")
        incremental.drain(incremental.pair_stream(spark, spec, 0.05, 0.05, 3), f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("anchor string, positive string, source string, split string").parquet(f"{path}/out").select("anchor", "positive", "source", "split")


@query("i04_resumed_enrichment", r"WITH s AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')[1:3] AS c FROM benchmark) SELECT item_id, len(c)::BIGINT AS n, coalesce(array_to_string(c, '|'), '') AS context, 'ok' AS status FROM s")
def resumed_enrichment(spark, sf):
    """A first run enriches a part; the second finds it in the sink and asks for the rest."""
    path = folder(spark, "i04")
    rows = t(spark, sf, "benchmark").select("item_id", "text")
    incremental.resumable(rows.where("item_id % 3 = 0"), "item_id", "text", SentenceAsker(), path)
    got = incremental.resumable(rows, "item_id", "text", SentenceAsker(), path)
    return got.select("item_id", F.size("context").cast("long").alias("n"), F.array_join("context", "|").alias("context"), "status")


@query("r15_embedded_once", "WITH k AS (SELECT conv_id, turn, sha256('words-64' || chr(10) || coalesce(text, '')) AS key FROM conversations) SELECT conv_id, turn, key, 64::BIGINT AS dim, (SELECT count(DISTINCT key) FROM k)::BIGINT AS kept, 0::BIGINT AS again FROM k")
def embedded_once(spark, sf):
    """A corpus and then its judged rows: what the first run embedded the second one reads."""
    path, model = folder(spark, "r15"), HashEmbedder()
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    embedded.embed_once(rows, "text", model, "words-64", path)
    parts = embedded.committed(spark, path)
    got = embedded.embed_once(rows, "text", model, "words-64", path)
    again = len([p for p in embedded.committed(spark, path) if p not in parts])
    kept = embedded.table(spark, path, model).agg(F.count("*").alias("kept"))
    return got.crossJoin(F.broadcast(kept)).select("conv_id", "turn", "key", F.size("embedding").cast("long").alias("dim"), "kept", F.lit(again).cast("long").alias("again"))  # one row


@query("k11_metrics_appended", "SELECT n_regionkey AS epoch, count(*)::BIGINT AS n, max(n_nationkey)::BIGINT AS top FROM nation GROUP BY 1")
def metrics_appended(spark, sf):
    """A line of metrics after each epoch in one CSV table, the header once in a file."""
    path = folder(spark, "k11")
    rows = t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("epoch")).agg(F.count("*").alias("n"), F.max("n_nationkey").cast("long").alias("top"))
    for epoch in range(5):
        writers.csv(rows.where(F.col("epoch") == epoch), path, "append")
    return spark.read.csv(path, schema="epoch int, n long, top long", header=True)
