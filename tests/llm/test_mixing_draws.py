"""Every place in a group is taken as often as any other."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.llm import mixing


def test_no_place_is_favoured(spark):
    n = 200 * mixing.GROUP
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(40)) + 5).cast("int")).alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(docs, (1,), 0.5)
    group = F.pmod(F.xxhash64("doc_id", "size", F.lit(mixing.SEED)), F.lit(n // mixing.GROUP))
    place = F.row_number().over(Window.partitionBy(group).orderBy("doc_id"))
    share = rows.select(place.alias("place"), "copies").where("place <= 64").groupBy("place").agg(F.avg("copies").alias("share")).toPandas().share
    assert len(share) == 64 and 0.3 < share.min() and share.max() < 0.7


def test_equal_rows_are_dealt_over_groups(spark):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(docs.union(spark.createDataFrame([(8, "d e", "t")], "doc_id long, text string, source string")), (1,), 0.5).groupBy("doc_id").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["n"] == 100_000 and abs(by[7]["taken"] - by[7]["target"]) <= 3
