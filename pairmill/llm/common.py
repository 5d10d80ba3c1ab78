"""Helpers shared by the operators: inputs, scratch tables, work sizes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.plans.places import folder

#: Characters of text that one numpy step works on at once.
STEP_CHARS = 2_000_000


#: Bytes of an Arrow batch between the JVM and a worker, which both hold it whole.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.pm_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that no later job reads."""
    for df in tables:
        if "pm_path" in vars(df):
            drop_path(df.sparkSession, df.pm_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in partitions of ascending ids; of equal ids (many, perhaps) by a hash of the text."""
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    return rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory; a worker lives on behind its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_CHARS):
    """Slices of a batch with about ``limit`` bytes of text each; one row at least. Memory that a step freed goes back."""
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    ends = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)
    ends = ends[col.offset : col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        give_back()
        at = to


#: Rows of a decision table up to which it is sent to all tasks; beyond, both sides are shuffled.
SENT_ROWS = 500_000


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the hash that, beside doc_id, tells its rows' texts apart."""
    return docs.withColumn("pm_hash__", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def decided(docs: DataFrame, decisions: DataFrame, how: str, names: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """docs joined with a decision table by id and text hash (columns doc_id and hash), and by what also names.

    how: left_anti drops the rows in decisions; inner brings the named columns.
    """
    side = decisions.select(F.col("doc_id").alias("pm_id__"), F.col("hash").alias("pm_h__"), *[F.col(c).alias(f"pm_{c}__") for c in also], *names)
    side = F.broadcast(side) if side.count() <= SENT_ROWS else side
    rows = keyed(docs)
    same = (rows["pm_hash__"] == F.col("pm_h__")) & F.col("doc_id").cast("long").eqNullSafe(F.col("pm_id__"))
    for c in also:
        same = same & F.col(c).cast("string").eqNullSafe(F.col(f"pm_{c}__"))
    return rows.join(side, same, how).select(*docs.columns, *names)
