"""Incremental runs: streams of files through stateless plans, resumable enrichment, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.operators.providers import Provider, enrich
from pairmill.operators.sampling import split_by_hash
from pairmill.sources import writers
from pairmill.sources.readers import SourceSpec, pairs


def pair_stream(spark: SparkSession, spec: SourceSpec, val: float, test: float, files: int = 1) -> DataFrame:
    """A stream of a source's pairs with their split; a row's split depends on its anchor alone."""
    rows = spark.readStream.schema(spec.schema).option("maxFilesPerTrigger", files).format(spec.format).options(**spec.options).load(spec.path)
    return split_by_hash(pairs(rows, spec).withColumn("source", F.lit(spec.name)), "anchor", val, test)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there now, by split, and stop; goes on where it stopped."""
    stream.writeStream.format("parquet").partitionBy("split").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resumable(todo: DataFrame, key: str, text: str, provider: Provider, path: str, batches: int = 4) -> DataFrame:
    """Enrich the rows that path lacks, in batches that are appended one by one; the whole table."""
    spark = todo.sparkSession
    for k in range(batches):
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        writers.append_new(enrich(part, key, text, provider), path, [key])
    return spark.read.parquet(path)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling counts and sums by type, on a batch or a stream."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))


def first_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events, of repeated ids the first, on a stream with bounded state."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
