"""Take and skip on a stream: the first rows to validation, the next to test, the rest to training.

A stream's rows have no positions, so a counter has to live on between its
batches. Every batch writes how many rows each split took; the next one, or
the same one after a restart, sums up what earlier batches wrote. Only as long
as rows are still to be taken is a batch sorted, and then no more than the
missing rows leave a task; later batches go to training as they come. A batch
that runs again overwrites what it wrote before, so a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of each held-out split where a stream's size isn't known.
UNKNOWN = 1_000


def sizes(total: int | None, val: float, test: float) -> tuple[int, int]:
    """(validation, test) rows of a stream of so many rows; of an unknown number, UNKNOWN where a share is asked for."""
    if total is None:
        return (UNKNOWN if val > 0 else 0), (UNKNOWN if test > 0 else 0)
    if total and val + test >= 1:
        raise ValueError("validation and test have to leave rows for training")
    return int(total * val), int(total * test)


def _taken(spark: SparkSession, path: str, batch: int) -> tuple[int, int]:
    """Rows of validation and test that batches before this one took."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0, 0
    rows = spark.read.schema("validation long, test long, batch long").parquet(f"{path}/counts").where(F.col("batch") < batch)
    got = rows.agg(F.coalesce(F.sum("validation"), F.lit(0)), F.coalesce(F.sum("test"), F.lit(0))).first()  # one row
    return got[0], got[1]


def take_and_skip(stream: DataFrame, key: str, n_val: int, n_test: int, path: str, checkpoint: str) -> None:
    """Write all that is there now to path/rows, with its split; goes on where it stopped.

    Within a batch rows come in order of key, which tells them apart. Writes
    path/counts beside them.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        val, test = _taken(spark, path, batch)
        need_val, need = n_val - val, n_val + n_test - val - test
        out = rows.withColumn("split", F.lit("train"))
        if need > 0:
            head = rows.select(key).orderBy(key).limit(need)  # the missing rows at most
            head = head.withColumn("place__", F.row_number().over(Window.orderBy(key)))
            named = head.select(F.col(key).alias("key__"), F.when(F.col("place__") <= need_val, "validation").otherwise("test").alias("held__"))
            out = rows.join(F.broadcast(named), F.col(key) == F.col("key__"), "left").withColumn("split", F.coalesce("held__", F.lit("train"))).drop("key__", "held__")
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        if need > 0:
            own = spark.read.schema(out.schema).parquet(f"{path}/rows/batch={batch}")
            own.agg(F.count_if(F.col("split") == "validation").alias("validation"), F.count_if(F.col("split") == "test").alias("test")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
