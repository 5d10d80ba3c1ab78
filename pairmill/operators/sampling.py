"""Splits, samples and weighted batches that depend on keys alone, not on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions.text import bucket
from pairmill.operators.positions import hashed, ranked, running, same


def split_by_hash(df: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """Adds split: train, validation or test by the key's hash; row-local, so it also works on streams."""
    at = bucket(F.col(key), f"#{seed}") / float(1 << 32)
    return df.withColumn("split", F.when(at < test, "test").when(at < test + val, "validation").otherwise("train"))


def stratified(df: DataFrame, strata: list[str], key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds held_out: true for round(share * n) rows of each stratum, the first by hash."""
    rows = ranked(df, strata, key, seed, "rank__")
    return rows.withColumn("held_out", F.col("rank__") < F.bround(F.col("n") * share)).drop("rank__", "n")


def capped(df: DataFrame, strata: list[str], key: str, most: int, seed: int = 42) -> DataFrame:
    """At most so many rows of each stratum, the first by hash; the limit is pushed before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(hashed(F.col(key), seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first by hash."""
    return df.orderBy(hashed(F.col(key), seed), key).limit(n)


def quota_sampled(df: DataFrame, cell: str, key: str, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """The first rows by hash of each cell, as many as quotas (cell, quota) say."""
    rows = ranked(df, [cell], key, seed, "rank__")
    return same(rows, quotas, [cell]).where("rank__ < quota").drop("rank__", "n", "quota")


def quota(counts: list[int], total: int) -> list[int]:
    """An even share for each cell, capped by its count; what is left goes to the last."""
    share = total // len(counts) if counts else 0
    out = [min(share, c) for c in counts]
    if out:
        out[-1] = min(counts[-1], out[-1] + total - sum(out))
    return out


def weighted_batches(rows: DataFrame, source: str, key: str, size: int, weights: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds batch_id, batch_seq: each source's full and last batches, taken weight times (half to even), short sources over again.

    weights: source, weight. Batches come in the order of a hash of seed and epoch.
    """
    placed = ranked(rows, [source], key, seed, "rank__").withColumn("batch", F.floor(F.col("rank__") / size)).drop("rank__", "n")
    have = placed.groupBy(source).agg((F.max("batch") + 1).alias("have")).join(weights, source)
    takes = have.withColumn("takes", F.bround(F.col("have") * F.col("weight")).cast("long"))
    takes = takes.where("takes > 0").select(source, "have", F.explode(F.sequence(F.lit(0), F.col("takes") - 1)).alias("turn"))
    takes = takes.withColumn("batch", F.pmod("turn", "have")).withColumn("order", F.md5(F.concat_ws("#", F.col(source), F.col("turn").cast("string"), F.lit(str(seed + epoch)))))
    takes = ranked(takes, [], "order", name="batch_seq").drop("n")
    return placed.join(takes.select(source, "batch", "turn", "batch_seq"), [source, "batch"])


def interleaved(rows: DataFrame, source: str, key: str) -> DataFrame:
    """Adds round: sources take turns until the longest is through, shorter ones over again. key: a whole number that tells a source's rows apart."""
    placed = running(rows.withColumn("_one", F.lit(1).cast("long")), [source], key, "_one", "_rn").drop("_one")
    n = placed.groupBy(source).agg(F.count("*").alias("_n"))
    longest = n.agg(F.max("_n").alias("_most"))
    times = F.explode(F.sequence(F.col("_rn"), F.col("_most") - 1, F.col("_n")))
    return same(placed, n, [source]).crossJoin(F.broadcast(longest)).withColumn("round", times).drop("_rn", "_n", "_most")  # one row
