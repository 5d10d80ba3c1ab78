"""Batches in which no text stands twice, made by dealing rows out; and orders in which sources' batches take turns."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.operators.positions import ranked, same
from pairmill.operators.retrieval import sent
from pairmill.plans.places import folder

#: Rounds of a level, in which a row tries its batches, before it goes to new ones.
ROUNDS = 4

#: Batches that a task has open for a source, at first and at most; rows, bytes and sources that it holds.
OPEN, MOST_OPEN = 16, 1_024
HELD, HELD_BYTES, HELD_SOURCES = 50_000, 32 << 20, 1_000

#: Batches beyond the least possible, as a factor, up to which a source's batches of single tasks stay.
SPARE = 1.1


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _near(rows: DataFrame, size: int) -> DataFrame:
    """rows (with key__, the source's hash, and own__, its texts' hashes) with part__ and batch: each task fills batches from the rows that it reads.

    Nothing is shuffled. Only full batches are given out, their rows one after
    another; rows that find no open batch, or stand in one that isn't full at
    last, have none (null). A row goes to the open batches in turns, so each of
    them gets its share of a frequent text.
    """
    import pyarrow as pa

    class Source:
        def __init__(self):
            self.rows, self.texts = [[] for _ in range(OPEN)], [[] for _ in range(OPEN)]
            self.all, self.turn = (1 << OPEN) - 1, 0
            self.at: dict[int, int] = {}  # the open batches, as bits, in which a text stands

        def place(self, row: int, mine: list[int]) -> list[int] | None:
            """The batch's rows if this one fills it, none while it is open; null if the row finds no place."""
            at, free = self.at, self.all
            for x in mine:
                free &= ~at.get(x, 0)
            if not free:
                if len(self.rows) >= MOST_OPEN:
                    return None
                free = 1 << len(self.rows)
                self.all |= free
                self.rows.append([])
                self.texts.append([])
            ahead = free >> self.turn << self.turn or free
            bit = ahead & -ahead
            k = bit.bit_length() - 1
            self.turn = k + 1
            own = self.rows[k]
            own.append(row)
            if len(own) < size:
                self.texts[k] += mine
                for x in mine:
                    at[x] = at.get(x, 0) | bit
                return []
            for x in self.texts[k]:
                if at[x] == bit:
                    del at[x]
                else:
                    at[x] ^= bit
            self.rows[k], self.texts[k] = [], []
            return own

    def run(batches):
        part = TaskContext.get().partitionId()
        sources: dict[int, Source] = {}
        full: dict[int, int] = {}
        held = None

        def out(rows: pa.Table, at: list[int], numbers: list[int | None]):
            got = rows.take(pa.array(at, pa.int64())).drop_columns(["key__", "own__"])
            got = got.append_column("part__", pa.array([part] * len(at), pa.int32())).append_column("batch", pa.array(numbers, pa.int64()))
            return got.combine_chunks().to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            have = 0 if held is None else held.num_rows
            if have:
                rows = pa.concat_tables([held, rows])
            own = batch["own__"]
            offs, texts = own.offsets.to_pylist(), own.values.to_pylist()
            at, numbers = [], []
            for i, key in enumerate(batch["key__"].to_pylist()):
                of = sources.get(key)
                if of is None:
                    of = sources[key] = Source()
                got = of.place(have + i, texts[offs[i] : offs[i + 1]])
                if got is None:
                    at.append(have + i)
                    numbers.append(None)
                elif got:
                    k = full.get(key, 0)
                    full[key] = k + 1
                    at += got
                    numbers += [k] * size
            n = rows.num_rows - len(at)
            most = min(HELD, HELD_BYTES * rows.num_rows // max(1, rows.nbytes))
            for key in list(sources):  # those of first rows long ago give up theirs
                if n <= most and len(sources) <= HELD_SOURCES:
                    break
                for own in sources.pop(key).rows:
                    at += own
                    numbers += [None] * len(own)
                    n -= len(own)
            if at:
                yield from out(rows, at, numbers)
            stay: list[int] = []
            for of in sources.values():
                for k, own in enumerate(of.rows):
                    if own:
                        of.rows[k] = list(range(len(stay), len(stay) + len(own)))
                        stay += own
            held = rows.take(pa.array(stay, pa.int64())).combine_chunks()
        if held is not None and held.num_rows:
            yield from out(held, list(range(held.num_rows)), [None] * held.num_rows)

    kept = [f for f in rows.schema.fields if f.name not in ("key__", "own__")]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("part__", T.IntegerType()), T.StructField("batch", T.LongType())]))


def _wasteful(full: DataFrame, done: DataFrame, left: DataFrame, own: Column, size: int) -> DataFrame:
    """The sources (source__) whose rows left over ask for so many batches that it is better to deal all of their rows anew.

    full: source__, batches. A frequent text that stands in few of a source's
    full batches asks for about as many again.
    """
    by = ["source__"]
    often = left.select(*by, F.explode(own).alias("text")).groupBy(*by, "text").agg(F.count("*").alias("c"))
    often = often.groupBy(*by).agg(F.max(F.struct("c", "text")).alias("top"))
    facts = same(same(full, left.groupBy(*by).agg(F.count("*").alias("rows")), by, "left"), often, by, "left")
    facts = facts.select(*by, "batches", F.ceil(F.coalesce("rows", F.lit(0)) / size).alias("more"), F.coalesce("top.c", F.lit(0)).alias("c"), F.col("top.text").alias("top"))
    need = F.col("batches") + F.greatest("more", "c")
    least = F.greatest(F.col("batches") + F.col("more"), "c")
    doubtful = _kept(facts.where(need > SPARE * least + 1), "batches-doubtful")
    # only for these, how often the text stands in full batches as well
    asked = same(done.withColumn("own__", own), sent(doubtful.select(*by, "top")), by)
    there = asked.where(F.expr("array_contains(own__, top)")).groupBy(*by).agg(F.count("*").alias("there"))
    least = F.greatest(least, F.col("c") + F.coalesce("there", F.lit(0)))
    return _kept(same(doubtful, there, by, "left").where(need > SPARE * least + 1).select(*by), "batches-wasteful")


def _settled(claims: DataFrame, by: list[str], size: int) -> DataFrame:
    """claims (by, batch, row, c, own, new) with won: a batch's rows are taken one after another while there is room and no text of theirs stands in it.

    Rows that stand there already (not new) come first, then those of frequent
    texts. A batch is a run of sorted rows; a task holds the texts of one.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        at, have, taken = None, 0, set()
        for batch in batches:
            own, n = batch["own"], batch.num_rows
            offs, texts, new = own.offsets.to_pylist(), own.values.to_pylist(), batch["new"].to_pylist()
            won = np.zeros(n, bool)
            for i, key in enumerate(batch["key__"].to_pylist()):
                if key != at:
                    at, have, taken = key, 0, set()
                mine = texts[offs[i] : offs[i + 1]]
                if have < size and taken.isdisjoint(mine):
                    taken.update(mine)
                    have += 1
                    won[i] = True
            out = batch.append_column("won", pa.array(won)).filter(pa.array(new, pa.bool_()))
            yield out.drop_columns(["key__", "new"])

    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # batches of one hash would share their room: no row is lost, it only tries again
    rows = claims.withColumn("key__", F.xxhash64(*by, "batch"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.drop("new").schema) + ", won boolean"
    return rows.repartition(n, "key__").sortWithinPartitions("key__", "new", F.desc("c"), "row").mapInArrow(run, schema)


def _level(items: DataFrame, by: list[str], size: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fresh batches: (by, row, batch of the rows that found one; by and the number of batches; items of the rows left over).

    items: by, row, own (hashes of distinct texts). Rows in order of their most
    frequent text are dealt to the batches in turns, so copies of it never meet
    and no batch gets more than ``size``; only other texts may clash.
    """
    spark = items.sparkSession
    each = items.select("row", F.explode("own").alias("text"))
    often = each.groupBy("text").agg(F.count("*").alias("c")).where("c > 1")
    top = each.join(often, "text").groupBy("row").agg(F.max(F.struct("c", "text")).alias("top"))
    rows = items.join(top, "row", "left").select(*by, "row", "own", F.coalesce("top.c", F.lit(0)).alias("c"), F.col("top.text").alias("top"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, "top", "row"]
    # written: ranges are sampled, and a task that runs again may not deal them anew
    rows = _kept(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("top").withColumn("at", F.monotonically_increasing_id()), "batches-dealt")
    part = F.shiftright("at", 33)
    sums = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    most = F.greatest(F.ceil(F.count("*") / size), F.max("c"), F.lit(1)).cast("long")
    batches = _kept(rows.groupBy(*by).agg(most.alias("batches")), "batches-n")
    few = sent(batches)
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    dealt = same(rows.withColumn("part", part).join(F.broadcast(before), "part"), few, by)
    claims = dealt.select(*by, F.pmod(place, F.col("batches")).alias("batch"), "row", "c", "own", F.lit(True).alias("new"))
    placed: DataFrame | None = None
    for k in range(ROUNDS):
        if placed is not None:
            asked = sent(claims.select(*by, "batch").distinct())
            claims = claims.unionByName(same(placed, asked, [*by, "batch"]).withColumn("new", F.lit(False)))
        got = _kept(_settled(claims, by, size), "batches-settled")
        won, left = got.where("won").drop("won"), got.where("NOT won").drop("won", "batch")
        placed = won if placed is None else placed.unionByName(won)
        if left.isEmpty():
            break
        tried = F.pmod(F.xxhash64("row", F.lit(seed + 7 * k + 1)), F.col("batches"))
        claims = same(left, few, by).select(*by, tried.alias("batch"), "row", "c", "own", F.lit(True).alias("new"))
    return placed.select(*by, "row", "batch"), batches, left.select(*by, "row", "own")


def no_repeats(rows: DataFrame, texts: list[str], size: int, source: str | None = None, seed: int = 42) -> DataFrame:
    """rows with batch: at most ``size`` rows a batch of a source, and none of the columns' texts stands in two of its rows.

    Each row stands in one batch; null texts clash with nothing; a text may
    stand in several columns of one row. Batches are as many as a source's rows
    or its most frequent text ask for, and some more where rows clash in all
    batches that they tried. Each task fills batches from what it reads; only
    the rows left over are shuffled, or a source's rows where that would waste
    batches. No task holds a source: rows of one text are dealt over batches by
    exact places, clashes are settled within a batch.
    """
    by = ["source__"]
    of = F.col(source) if source else F.lit(0)
    own = F.filter(F.array(*[F.col(c).cast("string") for c in texts]), lambda x: x.isNotNull())
    own = F.array_distinct(F.transform(own, lambda x: F.xxhash64(of, x)))  # texts of one hash stay apart like equal ones
    near = _kept(_near(rows.withColumn("key__", F.xxhash64(of)).withColumn("own__", own), size), "batches-near").withColumn("source__", of)
    done, left = near.where("batch IS NOT NULL"), near.where("batch IS NULL")
    parts = _kept(done.groupBy(*by, "part__").agg((F.max("batch") + 1).alias("own__")), "batches-parts")
    undone = _wasteful(parts.groupBy(*by).agg(F.sum("own__").alias("batches")), done, left, own, size)
    if not undone.isEmpty():
        undone = undone.withColumn("undone__", F.lit(True))
        near, parts = (same(x, sent(undone), by, "left") for x in (near, parts))
        parts = parts.where("undone__ IS NULL").drop("undone__")
        done, left = (near.where(x).drop("undone__") for x in ("batch IS NOT NULL AND undone__ IS NULL", "batch IS NULL OR undone__"))
    upto = Window.partitionBy(*by).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = parts.select(*by, "part__", F.coalesce(F.sum("own__").over(upto), F.lit(0)).alias("before__"))
    done = same(done, sent(before), [*by, "part__"]).withColumn("batch", F.col("batch") + F.col("before__")).select(*rows.columns, "batch")
    named = _kept(left.drop("part__", "batch").withColumn("row__", F.monotonically_increasing_id()), "batches-rows")
    items = named.select(*by, F.col("row__").alias("row"), own.alias("own"))
    offset = parts.groupBy(*by).agg(F.sum("own__").alias("batches"))
    out: DataFrame | None = None
    level = 0
    while not items.isEmpty():
        got, batches, items = _level(items, by, size, seed + 1_000 * level)
        got_at = same(got, sent(offset), by, "left").withColumn("batch", F.col("batch") + F.coalesce("batches", F.lit(0))).drop("batches")
        offset = _kept(offset.unionByName(batches).groupBy(*by).agg(F.sum("batches").alias("batches")), "batches-offset")
        out = got_at if out is None else out.unionByName(got_at)
        level += 1
    if out is None:
        return done
    rest = named.join(out.select(F.col("row").alias("row__"), "batch"), "row__").select(*rows.columns, "batch")
    return done.unionByName(_kept(rest, "batches-rest"))


def proportional(batches: DataFrame, source: str, seed: int = 42) -> DataFrame:
    """batches (source, batch) with seq: every batch once, sources drawn in proportion to what they have."""
    rows = batches.withColumn("key__", F.concat_ws("#", F.coalesce(F.col(source).cast("string"), F.lit("")), F.col("batch").cast("string")))
    return ranked(rows, [], "key__", seed, "seq").drop("key__", "n")


def round_robin(batches: DataFrame, source: str) -> DataFrame:
    """batches (source, batch from 0) with seq: sources take turns and stop where the first of them has no more."""
    have = batches.groupBy(source).agg((F.max("batch") + 1).alias("have"))
    turn = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1  # a row for each source
    order = have.select(source, turn.alias("turn"), F.min("have").over(Window.partitionBy()).alias("least"), F.count("*").over(Window.partitionBy()).alias("sources"))
    rows = same(batches, order, [source]).where("batch < least")
    return rows.withColumn("seq", F.col("batch") * F.col("sources") + F.col("turn")).drop("turn", "least", "sources")
