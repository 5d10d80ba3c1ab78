"""Exact positions, shards and buffers against plain Python."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pairmill.operators import batching, positions


def md5(key, seed=42):
    return hashlib.md5(f"{key}#{seed}".encode()).hexdigest()


def test_ranks_over_many_cells(spark):
    """One group holds most rows; groups and keys may be null."""
    rows = [("hot" if n % 10 else None if n % 20 else "cold", n) for n in range(5_000)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(5)
    want = {}
    for g in {r[0] for r in rows}:
        for k, i in enumerate(sorted((i for h, i in rows if h == g), key=lambda i: (md5(i), i))):
            want[i] = (k, sum(h == g for h, _ in rows))
    for part in (7, 300, 100_000):
        got = positions.ranked(df, ["g"], "id", part=part).collect()
        assert {r["id"]: (r["rank"], r["n"]) for r in got} == want and len(got) == 5_000
    assert positions.ranked(df.where("id < 0"), ["g"], "id").collect() == [] == positions.ranked(df.where("id < 0"), [], "id").collect()


def test_running_sums(spark):
    rows = [(g, n * 3, (n * 7) % 5) for g in ("a", None) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r["g"], r["o"]): r["s"] for r in positions.running(df, ["g"], "o", "v", "s", part=100).collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}


def test_shards_resume(spark):
    """Two halves with a resume are one whole run; every rank has as many turns, the first rows fill the last one."""
    df = spark.range(100).withColumnRenamed("id", "k")
    order = sorted(range(100), key=lambda i: (md5(i, 45), i))
    whole = sorted((r["rank"], r["turn"], r["k"]) for r in positions.rank_shards(df, "k", 3, epoch=3).collect())
    assert whole == sorted((p % 3, p // 3, order[p % 100]) for p in range(102))
    done = spark.createDataFrame([(0, 10), (1, 10), (2, 9)], "rank int, yielded long")
    rest = sorted((r["rank"], r["turn"], r["k"]) for r in positions.rank_shards(df, "k", 3, done, epoch=3).collect())
    assert rest == [x for x in whole if x[1] >= (10, 10, 9)[x[0]]]
    assert positions.rank_shards(df, "k", 3, drop_last=True).count() == 99
    assert sorted(r["rank"] for r in positions.rank_shards(df.limit(2), "k", 5).collect()) == [0, 1, 2, 3, 4]


def test_shuffle_buffer(spark):
    df = spark.range(3_000).withColumn("t", F.concat(F.lit("x"), "id"))
    runs = [[tuple(r) for r in positions.buffer_shuffled(df, "id", 50, shards=2).orderBy("shard", "place").select("shard", "place", "came", "id", "t").collect()] for _ in range(2)]
    assert runs[0] == runs[1]
    for shard in (0, 1):
        own = [r for r in runs[0] if r[0] == shard]
        came = [r[2] for r in own]
        assert [r[1] for r in own] == list(range(len(own))) == sorted(came)
        assert all(c <= p + 50 for p, c in enumerate(came))  # nothing leaves before it has come
        assert np.mean([abs(c - p) for p, c in enumerate(came)]) > 20
        assert [r[3] for r in sorted(own, key=lambda r: r[2])] == sorted(r[3] for r in own)
    assert {r[3] for r in runs[0]} == set(range(3_000)) and all(r[4] == f"x{r[3]}" for r in runs[0])
    assert positions.buffer_shuffled(df.where("id < 0"), "id").collect() == []
    assert positions.buffer_shuffled(df.limit(5), "id", 50, shards=1).count() == 5


def check_batches(rows, texts, size):
    by = {}
    for r in rows:
        by.setdefault((r["source"], r["batch"]), []).append(r)
    for own in by.values():
        assert len(own) <= size
        seen = set()
        for r in own:
            mine = {r[t] for t in texts} - {None}
            assert not mine & seen
            seen |= mine
    return by


def test_batches_without_repeats(spark):
    rng = random.Random(1)
    rows = [(n, "one" if n % 4 else None, f"a{rng.randrange(300)}" if n % 3 else None, "hot" if n % 7 == 0 else f"p{rng.randrange(5_000)}") for n in range(4_000)]
    rows += [(5_000 + n, "two", "same", "same") for n in range(40)] + [(6_000 + n, "two", None, None) for n in range(10)]
    df = spark.createDataFrame(rows, "id long, source string, anchor string, positive string")
    got = batching.no_repeats(df, ["anchor", "positive"], 16, "source").collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    by = check_batches(got, ["anchor", "positive"], 16)
    assert sum(s == "two" for s, _ in by) == 40  # as many as copies of one text
    hot = sum(r[1] == "one" and r[3] == "hot" for r in rows)
    assert sum(s == "one" for s, _ in by) <= 1.5 * max(hot, -(-sum(r[1] == "one" for r in rows) // 16)) + 4
    assert batching.no_repeats(df.where("id < 0"), ["anchor"], 16).collect() == []


def test_one_source_of_many_rows(spark):
    """100,000 rows of one source: no group of a job holds them."""
    df = spark.range(100_000).select("id", F.lit("s").alias("source"), F.when(F.col("id") % 50 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(60_000)))).alias("text"))
    got = batching.no_repeats(df, ["text"], 32, "source").groupBy("source", "batch").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts")).toPandas()
    assert got.n.sum() == 100_000 and (got.n == got.texts).all() and got.n.max() <= 32 and len(got) <= 1.3 * 100_000 / 32


def test_orders_of_batches(spark):
    rows = [("a", n) for n in range(5)] + [("b", n) for n in range(3)] + [("c", n) for n in range(9)]
    df = spark.createDataFrame(rows, "source string, batch long")
    got = sorted((r["seq"], r["source"], r["batch"]) for r in batching.round_robin(df, "source").collect())
    assert got == [(n * 3 + k, s, n) for n in range(3) for k, s in enumerate("abc")]
    got = [(r["source"], r["batch"]) for r in batching.proportional(df, "source").orderBy("seq").collect()]
    assert got == sorted(rows, key=lambda r: md5(f"{r[0]}#{r[1]}"))


def test_every_shuffled_row_is_returned(spark):
    """the query gives each row with its place, as SQL over hashes does; also where buffers run full, and with repeated and missing keys."""
    import duckdb
    from oracle import assert_same, connect

    from pairmill.plans import catalog, dealt

    got = catalog.queries()["m11_shuffled"](spark, "/root/testdata/sf0.01")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    assert_same(got, connect("/root/testdata/sf0.01"), catalog.oracle_sql()["m11_shuffled"])
    con = duckdb.connect()
    con.execute("create table few as select (i // 2)::BIGINT as k from range(2000) r(i)")
    few = spark.createDataFrame([(n // 2,) for n in range(2_000)], "k long")
    assert_same(positions.buffer_shuffled(few, "k", 30, shards=3), con, dealt._BUFFER.format(key="k", table="few", shards=3, size=30))
    assert positions.buffer_shuffled(spark.createDataFrame([(None,), (1,)], "k long"), "k", 1, shards=1).count() == 2


def shuffled_bytes(spark):
    return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().executorList(True)))


def test_batches_shuffle_little(spark):
    """rows are dealt to full batches at once; no round of tries shuffles all of them again."""
    rows = spark.range(60_000).select(F.lit("s").alias("source"), "id", F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(2_000))).alias("anchor"), F.concat(F.lit("o"), F.floor(F.col("id") / 4)).alias("positive"))
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = batching.no_repeats(rows, ["anchor", "positive"], 32, "source").toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 60_000 and got.batch.nunique() <= 1.1 * 60_000 / 32
    assert got.groupby("batch").anchor.nunique().sum() == got.groupby("batch").positive.nunique().sum() == 60_000
    assert shuffled_bytes(spark) - before < 400 * 60_000


def test_batches_are_filled_where_rows_are_read(spark):
    """a task fills batches from its own rows; only those left over are shuffled."""
    n = 200_000
    rows = spark.range(0, n, 1, 4).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), "id", F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(7_000))).alias("anchor"), F.concat(F.lit("o"), F.floor(F.col("id") / 4)).alias("positive"))
    before = shuffled_bytes(spark)
    got = batching.no_repeats(rows, ["anchor", "positive"], 32, "source")
    assert shuffled_bytes(spark) - before < 20 * n  # before: 106 bytes a row
    got = got.collect()
    assert sorted(r["id"] for r in got) == list(range(n))
    by = check_batches(got, ["anchor", "positive"], 32)
    assert len(by) <= 1.05 * n / 32
    for source in (None, "s1", "s2"):
        own = [b for s, b in by if s == source]
        assert min(own) == 0 and max(own) < 1.05 * n / 3 / 32


def test_frequent_text_in_one_place(spark):
    """where full batches of single tasks would waste batches, a source's rows are all dealt anew; the other source's batches stay."""
    rows = spark.range(0, 40_000, 1, 4).select((F.col("id") % 2).alias("source"), "id", F.when((F.col("id") >= 30_000) & (F.col("id") % 2 == 0), F.lit("hot")).when((F.col("id") % 10 == 1), F.lit("even")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    by = check_batches(batching.no_repeats(rows, ["text"], 8, "source").collect(), ["text"], 8)
    assert sum(map(len, by.values())) == 40_000
    assert sum(s == 0 for s, _ in by) == 5_000  # as many as copies of one text; with full batches of 8 kept 1,875 more
    assert sum(s == 1 for s, _ in by) <= 1.1 * 4_000 + 1


def test_tasks_hold_few_rows(spark, monkeypatch):
    """rows beyond what a task may hold are dealt as rows left over; any number of sources, and types that only pass through."""
    monkeypatch.setattr(batching, "HELD", 500)
    monkeypatch.setattr(batching, "HELD_SOURCES", 20)
    monkeypatch.setattr(batching, "MOST_OPEN", 32)
    rows = spark.range(0, 30_000, 1, 2).select(F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64("id"), F.lit(700))).alias("source"), "id", F.when(F.col("id") % 40 == 1, F.lit("hot")).otherwise(F.pmod(F.hash("id"), F.lit(9_000)).cast("string")).alias("text"), F.array(F.struct("id")).alias("a"), F.timestamp_seconds("id").alias("at"), F.lit("x").cast("binary").alias("b"), F.col("id").cast("decimal(20,3)").alias("d"))
    got = batching.no_repeats(rows, ["text"], 8, "source")
    assert got.schema.simpleString().removesuffix(",batch:bigint>") == rows.schema.simpleString().removesuffix(">")
    got = got.collect()
    assert sorted(r["id"] for r in got) == list(range(30_000)) and all(r["a"][0]["id"] == r["d"] == r["id"] == int(r["at"].timestamp()) for r in got)
    by = check_batches(got, ["text"], 8)
    assert sum(s is None for s, _ in by) <= 1.2 * 15_000 / 8


def test_batches_are_checked(spark):
    """what holds of given batches, against counts in plain Python; missing sources and texts, rows of a batch apart."""
    from pairmill.plans import dealt

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(300), rng.randrange(3_000), rng.choice([None, f"p{rng.randrange(40)}"]), f"o{n % 997}") for n in range(4_000)]
    rows += [("hot", n, 10_000 + n, "same", f"o{n}") for n in range(70)] + [("many", n, 20_000 + n, f"p{n}", None) for n in range(70)] + [("good", n // 8, 30_000 + n, f"p{n}", f"o{n}") for n in range(64)]
    want = set()
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        texts = [(r[1], x) for r in own for x in r[3:] if x is not None]
        in_batch = {x: texts.count(x) for x in set(texts)}
        sizes = {b: sum(r[1] == b for r in own) for b in {r[1] for r in own}}
        words = [x for _, x in texts]
        least = max(max(words.count(x) for x in set(words)), -(-len(own) // 8))
        want.add((s, len(own), len({r[2] for r in own}), sum(n > 1 for n in in_batch.values()), sum(n > 8 for n in sizes.values()), len(sizes) <= 1.5 * least + 8))
    df = spark.createDataFrame(rows, "source string, batch long, id long, anchor string, positive string")
    for one in (df.repartition(5), df.coalesce(1).sortWithinPartitions("source", "batch")):
        got = dealt.batches_checked(one, "source", "id", ["anchor", "positive"], 8).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {(r[0], r[3], r[5]) for r in want if r[0] in ("hot", "many", "good")} == {("hot", 0, True), ("many", 0, False), ("good", 0, True)}
