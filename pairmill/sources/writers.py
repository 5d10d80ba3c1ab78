"""Writers: tables, JSON lines, judgement files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.plans.places import folder


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def qrels(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Judgements, tab-separated with a header; by: a folder for each value."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).csv(path, sep="\t", header=True)


def file_name(col: Column) -> Column:
    """A value as part of a file's name: lower case, blanks as _."""
    return F.replace(F.lower(F.trim(col)), F.lit(" "), F.lit("_"))


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, a key's new row before its old one."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table at path lacks; how many were new."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(*keys).distinct(), keys, "left_anti")
    before = df.count()
    if before:
        df.write.mode("append").parquet(path)
    return before


def predictions(ranked: DataFrame, path: str) -> None:
    """A JSON line for each query: query_id, results (corpus_id, score), best first."""
    order = F.sort_array(F.collect_list(F.struct("score", "corpus_id")), asc=False)
    ranked.groupBy("query_id").agg(order.alias("r")).select("query_id", F.transform("r", lambda x: F.struct(x["corpus_id"].alias("corpus_id"), x["score"].alias("score"))).alias("results")).write.mode("overwrite").json(path)


def markdown(small: DataFrame, most: int = 1000) -> str:
    """A report of a few rows as a Markdown table."""
    rows = small.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(small.columns) + " |", "|" + "---|" * len(small.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])


def dense_ids(df: DataFrame, key: str, prefix: str, name: str = "_id") -> DataFrame:
    """prefix0, prefix1, ... in order of a key that tells rows apart.

    Counted by ranges of the key: rows are ranked within a range, and the
    ranges' totals, one row each, are summed up; no task sees all rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = folder(spark, "dense")  # written: ranges are sampled, and a task that runs again may not deal them anew
    df.repartitionByRange(n, key).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(df.withColumn("_range", F.lit(0)).schema).parquet(path)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = totals.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_range").withColumn(name, F.concat(F.lit(prefix), (F.col("_local") + F.col("_before")).cast("string"))).drop("_range", "_local", "_before")
