"""Queries: kept sources, reports, encoders, and functions over batches and groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pairmill.operators.providers import HashEmbedder, enrich
from pairmill.plans.curate import t
from pairmill.plans.places import folder
from pairmill.plans.registry import query
from pairmill.sources import readers, writers


@query("s20_kept_source", "SELECT text AS anchor, role AS positive, NULL::VARCHAR AS negative, 1::BIGINT AS computed FROM conversations WHERE text <> '' AND role <> ''")
def kept_source(spark, sf):
    """A source's pairs, computed once: the second reading finds the folder, although the source is gone."""
    path = folder(spark, "s20")
    writers.jsonl(t(spark, sf, "conversations").select("text", "role"), f"{path}/in")
    spec = readers.SourceSpec("talk", f"{path}/in", "json", "text string, role string", anchor="text", positive="role")
    readers.materialised(spark, spec, f"{path}/kept")
    writers.jsonl(t(spark, sf, "conversations").select("text", "role").limit(0), f"{path}/in")
    return readers.materialised(spark, spec, f"{path}/kept").withColumn("computed", F.lit(1).cast("long"))


@query("k13_markdown_report", "SELECT '| lang | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || coalesce(lang, '') || ' | ' || n || ' |', chr(10) ORDER BY n DESC, lang) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def markdown_report(spark, sf):
    by = t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    return spark.createDataFrame([(writers.markdown(by),)], "report string")


@query("v17_encoded_texts", "SELECT conv_id, turn, 64::BIGINT AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, 'ok' AS status FROM conversations")
def encoded_texts(spark, sf):
    """Texts encoded batch by batch by a model that each worker makes once."""
    rows = t(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("key"), "text")
    got = enrich(rows, "key", "text", HashEmbedder())
    at = F.split("key", "_")
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    return got.select(F.get(at, F.lit(0)).cast("long").alias("conv_id"), F.get(at, F.lit(1)).cast("long").alias("turn"), F.size("embedding").cast("long").alias("dim"), F.round(norm, 4).alias("norm"), "status")


@query("x02_batches_of_other_size", "SELECT page_id, part, place FROM (SELECT page_id, unnest(list_filter(string_split(url, '/'), lambda x: x <> '')) AS part, generate_subscripts(list_filter(string_split(url, '/'), lambda x: x <> ''), 1) AS place FROM pages)")
def batches_of_other_size(spark, sf):
    """A function of a batch of columns that gives more rows than it takes."""

    def run(batches):
        for pdf in batches:
            parts = [[x for x in u.split("/") if x] for u in pdf["url"]]
            yield pd.DataFrame({"page_id": [i for i, ps in zip(pdf["page_id"], parts) for _ in ps], "part": [p for ps in parts for p in ps], "place": [k + 1 for ps in parts for k in range(len(ps))]})

    return t(spark, sf, "pages").select("page_id", "url").mapInPandas(run, "page_id long, part string, place long")


@query("x04_groups", "SELECT conv_id, count(*)::BIGINT AS turns, max(coalesce(length(text), 0))::BIGINT AS longest, count(DISTINCT role)::BIGINT AS roles FROM conversations GROUP BY 1")
def groups(spark, sf, part: int = 1_000):
    """A function of each group, cut into parts of so many turns; what parts give is put together by aggregates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf["text"].fillna("")
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "turns": [len(pdf)], "longest": [int(texts.str.len().max())], "roles": [sorted(set(pdf["role"].dropna()))]})

    parts = t(spark, sf, "conversations").withColumn("part", F.floor(F.col("turn") / part))
    each = parts.groupBy("conv_id", "part").applyInPandas(run, "conv_id long, turns long, longest long, roles array<string>")
    counts = each.groupBy("conv_id").agg(F.sum("turns").alias("turns"), F.max("longest").alias("longest"))
    roles = each.select("conv_id", F.explode_outer("roles").alias("role")).groupBy("conv_id").agg(F.count_distinct("role").alias("roles"))
    return counts.join(roles, "conv_id")
