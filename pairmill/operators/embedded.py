"""Embed each text once: a table addressed by content, with committed parts.

A row's key is the SHA-256 of the model's name and the text, so a text that
stands in many corpora, queries or judgement files is embedded once for a
model. New texts are dealt over parts by key; a part is written to a folder of
its own and then named in the manifest by one rename. What the manifest
doesn't name is not there: a run that was killed leaves no half part, and the
next one asks for the rest alone. A text whose call failed isn't kept and is
asked for again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.operators.providers import Provider, enrich


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts that the manifest holds; one for each part of a run."""
    _, at, fs = _hadoop(spark, f"{path}/manifest")
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _commit(spark: SparkSession, path: str, name: str) -> None:
    """One rename puts the part's name into the manifest."""
    jvm, _, fs = _hadoop(spark, path)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest"))
    ready = jvm.org.apache.hadoop.fs.Path(f"{path}/ready/{name}")
    fs.mkdirs(ready.getParent())
    fs.create(ready).close()
    if not fs.rename(ready, jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{name}")):
        raise OSError(f"{name} couldn't be committed")


def table(spark: SparkSession, path: str, provider: Provider) -> DataFrame:
    """key and the provider's columns of all that is committed."""
    schema = f"key string, {provider.schema}"
    names = committed(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/parts/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def key(model: str, text: str = "text"):
    return F.sha2(F.concat(F.lit(f"{model}\n"), F.coalesce(F.col(text), F.lit(""))), 256)


def embed_once(texts: DataFrame, text: str, provider: Provider, model: str, path: str, parts: int = 4) -> DataFrame:
    """texts with key and the provider's columns; only texts that path lacks are asked for. A null text counts as empty."""
    spark = texts.sparkSession
    keyed = texts.withColumn("key", key(model, text))
    todo = keyed.select("key", F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["key"])
    for k in range(parts):
        mine = todo.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).join(table(spark, path, provider).select("key"), "key", "left_anti")
        name = f"{k}-{uuid.uuid4().hex}"
        enrich(mine, "key", "text", provider).where("status = 'ok'").drop("status").write.parquet(f"{path}/parts/{name}")
        if not spark.read.schema("key string").parquet(f"{path}/parts/{name}").isEmpty():
            _commit(spark, path, name)
    return keyed.join(table(spark, path, provider), "key", "left")
