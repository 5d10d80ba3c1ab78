"""Exact positions within groups of any size: counts of cells first, offsets after.

A row's place comes from the hash of its key. The hash's range is cut into
cells of about PART rows; a row's rank in its cell and the rows of the cells
before it give its rank, so no task sees a whole group, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions.text import bucket
from pairmill.operators.retrieval import sent

#: Rows of a cell, on average.
PART = 100_000


def hashed(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where the columns by agree; nulls agree with nulls."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.select(*[F.col(c).alias(f"{c}__r") for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & left[c].eqNullSafe(other[f"{c}__r"])
    return left.join(other, on, how).drop(*[f"{c}__r" for c in by])


def ranked(df: DataFrame, by: list[str], key: str, seed: int = 42, name: str = "rank", part: int | None = None) -> DataFrame:
    """Adds name (0, 1, ... in order of the key's hash, then of the key, within by) and n, the group's rows."""
    part = part or PART
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    rows = same(df, sent(sizes) if by else sizes, by)
    at = bucket(F.col(key), f"#{seed}") / float(1 << 32)
    rows = rows.withColumn("cell__", F.when(F.col("n") <= part, 0).otherwise(F.floor(F.coalesce(at, F.lit(0.0)) * F.ceil(F.col("n") / part))).cast("long"))
    local = F.row_number().over(Window.partitionBy(*by, "cell__").orderBy(hashed(F.col(key), seed), key)) - 1
    cells = rows.where(F.col("n") > part).groupBy(*by, "cell__").agg(F.count("*").alias("own__"))
    upto = Window.partitionBy(*by).orderBy("cell__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    before = cells.select(*by, "cell__", F.sum("own__").over(upto).alias("before__"))
    out = same(rows.withColumn(name, local), sent(before), [*by, "cell__"], "left")
    return out.withColumn(name, (F.col(name) + F.coalesce("before__", F.lit(0))).cast("long")).drop("cell__", "before__")


def running(df: DataFrame, by: list[str], order: str, value: str, name: str, part: int | None = None) -> DataFrame:
    """Adds name: the sum of value over the rows of the group before this one, by a whole number that tells its rows apart.

    Numbers are cut into runs of PART; runs' sums come first.
    """
    part = part or PART
    rows = df.withColumn("run__", F.floor(F.col(order) / part))
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*by, "run__").agg(F.sum(value).alias("own__"))
    before = runs.select(*by, "run__", F.sum("own__").over(ahead(*by).orderBy("run__")).alias("before__"))
    local = F.coalesce(F.sum(value).over(ahead(*by, "run__").orderBy(order)), F.lit(0))
    return same(rows.withColumn(name, local), before, [*by, "run__"]).withColumn(name, F.col(name) + F.coalesce("before__", F.lit(0))).drop("run__", "before__")


def shuffled_split(df: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """Adds split: all rows shuffled, the first share test, the next validation, the rest train; whole numbers of rows."""
    rows = ranked(df, [], key, seed, "place__")
    n_test, n_val = F.floor(F.col("n") * test + 1e-9), F.floor(F.col("n") * val + 1e-9)
    split = F.when(F.col("place__") < n_test, "test").when(F.col("place__") < n_test + n_val, "validation").otherwise("train")
    return rows.withColumn("split", split).drop("place__", "n")


def rank_shards(df: DataFrame, key: str, ranks: int, done: DataFrame | None = None, seed: int = 42, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Adds rank and turn: the shuffled rows dealt out in turns; every rank gets as many.

    The first rows stand a second time where the last turn isn't full, or,
    with drop_last, that turn goes. done (rank, yielded) are the turns that
    each rank has had before: it goes on behind them.
    """
    rows = ranked(df, [], key, seed + epoch, "place__")
    full = F.floor(F.col("n") / ranks) if drop_last else F.ceil(F.col("n") / ranks)
    total = full * ranks
    # a row stands at its place and, to fill the last turn, at n + place and on, in tables shorter than a turn
    places = F.sequence(F.col("place__"), F.greatest(F.col("place__"), total - 1), F.greatest(F.col("n"), F.lit(1)))
    rows = rows.withColumn("total__", total).withColumn("place__", F.explode(places)).where("place__ < total__")
    rows = rows.withColumn("rank", F.pmod("place__", F.lit(ranks)).cast("int")).withColumn("turn", F.floor(F.col("place__") / ranks)).drop("place__", "n", "total__")
    if done is None:
        return rows
    had = F.broadcast(done.select(F.col("rank").alias("rank__"), "yielded").limit(ranks))  # a row for each rank
    return rows.join(had, F.col("rank") == F.col("rank__"), "left").where(F.col("turn") >= F.coalesce("yielded", F.lit(0))).drop("rank__", "yielded")


#: Rows of a shuffle buffer.
BUFFER = 10_000


def buffer_shuffled(df: DataFrame, order: str, size: int = BUFFER, seed: int = 42, shards: int | None = None) -> DataFrame:
    """Adds shard, came and place: rows of each shard as a shuffle buffer gives them.

    A shard is a share of the rows by a hash of ``order``, which tells rows
    apart, read in that order (came: 0, 1, ...). A buffer of ``size`` rows lives
    on over the shard's batches: each row that comes takes the place of a drawn
    one, which leaves (place: 0, 1, ...); the rest leave shuffled at the end, in
    order of their hashes. Shards and draws come from the hash as well, so
    reruns and other engines agree; only a buffer and a batch are in memory.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    class Buffer:
        def __init__(self, shard: int):
            self.shard, self.held, self.came, self.place = shard, None, 0, 0

        def out(self, rows: pa.Table):
            n = rows.num_rows
            at = pa.array(np.arange(self.place, self.place + n), pa.int64())
            self.place += n
            return rows.append_column("came", rows["came__"]).append_column("place", at).drop_columns(["came__", "hash__", "draw__"]).combine_chunks().to_batches()

        def add(self, batch: pa.RecordBatch):
            new = pa.Table.from_batches([batch]).append_column("came__", pa.array(np.arange(self.came, self.came + batch.num_rows), pa.int64()))
            self.came += batch.num_rows
            rows = new if self.held is None else pa.concat_tables([self.held, new])
            have = rows.num_rows - batch.num_rows
            slots, leave = list(range(have)), []
            draws = batch["draw__"].to_pylist()
            for i in range(have, rows.num_rows):
                if len(slots) < size:
                    slots.append(i)
                else:
                    k = draws[i - have]
                    leave.append(slots[k])
                    slots[k] = i
            self.held = rows.take(pa.array(slots, pa.int64()))
            return self.out(rows.take(pa.array(leave, pa.int64()))) if leave else []

        def rest(self):
            return self.out(self.held.take(pc.sort_indices(self.held, sort_keys=[("hash__", "ascending"), ("came__", "ascending")])))

    def run(batches):
        own = None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, z in zip(edge, edge[1:]):
                if a == z:
                    continue
                if own is None or own.shard != shard[a]:
                    if own is not None:
                        yield from own.rest()
                    own = Buffer(int(shard[a]))
                yield from own.add(batch.slice(a, z - a))
        if own is not None:
            yield from own.rest()

    n = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = lambda at: F.coalesce(F.conv(F.substring("hash__", at, 8), 16, 10).cast("long"), F.lit(0))  # noqa: E731  a missing key has no hash
    rows = df.withColumn("hash__", hashed(F.col(order), seed)).withColumn("shard", F.pmod(part(1), F.lit(n)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("hash__").schema) + ", came long, place long"
    rows = rows.withColumn("draw__", F.pmod(part(9), F.lit(size)).cast("int"))
    return rows.repartition(n, "shard").sortWithinPartitions("shard", order).mapInArrow(run, schema)
