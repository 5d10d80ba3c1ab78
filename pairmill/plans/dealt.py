"""Queries: positions, shards, shuffle buffers and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.operators import batching, positions, sampling
from pairmill.operators.retrieval import sent
from pairmill.plans.curate import t
from pairmill.plans.places import folder
from pairmill.plans.registry import query

_ORDER = "row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '#42'), o_orderkey) - 1"


@query("m07_shuffled_split", f"WITH p AS (SELECT o_orderkey, {_ORDER} AS place, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN place < floor(n * 0.05 + 1e-9) THEN 'test' WHEN place < 2 * floor(n * 0.05 + 1e-9) THEN 'validation' ELSE 'train' END AS split FROM p")
def shuffled_split(spark, sf):
    return positions.shuffled_split(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.05, 0.05)


@query("m02_empty_split", "WITH p AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR || '#42'), o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' AND place < floor(n * 0.1 + 1e-9) THEN 'test' WHEN o_orderstatus = 'P' AND place < floor(n * 0.1 + 1e-9) THEN 'validation' WHEN o_orderstatus IN ('O', 'P') THEN 'train' ELSE 'test' END AS split FROM p")
def empty_split(spark, sf):
    """Shares of nothing: F keeps all for training, O has no validation, P no test, and others are test alone."""
    rows = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    shares = {"F": (0.0, 0.0), "O": (0.0, 0.1), "P": (0.1, 0.0)}
    parts = [positions.shuffled_split(rows.where(F.col("o_orderstatus") == s), "o_orderkey", val, test) for s, (val, test) in shares.items()]
    parts.append(positions.shuffled_split(rows.where(~F.col("o_orderstatus").isin(*shares)), "o_orderkey", 0.0, 1.0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("o_orderkey", "split")


@query("m09_samplers", "WITH n AS (SELECT source, ceil(count(*) / 32.0)::BIGINT AS have FROM documents GROUP BY 1), b AS (SELECT source, unnest(range(0, have)) AS batch FROM n), s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS turn, min(have) OVER () AS least, count(*) OVER () AS sources FROM n) SELECT b.source, batch, row_number() OVER (ORDER BY md5(b.source || '#' || batch || '#42')) - 1 AS proportional, CASE WHEN batch < least THEN batch * sources + turn END AS round_robin FROM b JOIN s USING (source)")
def samplers(spark, sf):
    """Orders in which sources' batches take turns."""
    rows = positions.ranked(t(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id")
    batches = rows.select("source", F.floor(F.col("rank") / 32).alias("batch")).distinct()
    turns = batching.round_robin(batches, "source").select("source", "batch", F.col("seq").alias("round_robin"))
    return batching.proportional(batches, "source").withColumnRenamed("seq", "proportional").join(turns, ["source", "batch"], "left")


@query("m10_no_repeats", "SELECT l_returnflag, count(*)::BIGINT AS rows, count(*)::BIGINT AS different, 0::BIGINT AS repeats, 0::BIGINT AS over, true AS few FROM lineitem GROUP BY 1")
def no_repeats(spark, sf, size: int = 32):
    """Batches of pairs in which no part and no order stands twice: what holds of them, by source."""
    rows = t(spark, sf, "lineitem").select("l_returnflag", F.monotonically_increasing_id().alias("id"), F.concat(F.lit("p"), "l_partkey").alias("anchor"), F.concat(F.lit("o"), "l_orderkey").alias("positive"))
    return batches_checked(batching.no_repeats(rows, ["anchor", "positive"], size, "l_returnflag"), "l_returnflag", "id", ["anchor", "positive"], size)


def batches_checked(got, source: str, key: str, texts: list[str], size: int):
    """A row a source: rows, different keys (whole numbers from 0), texts that stand in several rows of a batch, batches of more than size rows, and whether the batches are few.

    A batch's rows mostly stand together, so it is looked at where it is read.
    What stands in several places, or has a hash twice, is counted by its texts.
    """
    path = folder(got.sparkSession, "m10")
    runs = _runs(got.select(source, "batch", *[F.xxhash64(c).alias(c) for c in texts]), source, texts)
    runs.groupBy(source, "batch").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.max("twice").alias("twice")).write.parquet(path)
    batches = got.sparkSession.read.parquet(path)
    by = batches.groupBy(source).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > size).alias("over"), F.count("*").alias("batches"))
    each = lambda df, *keys: df.select(*keys, F.explode(F.array(*texts)).alias("text")).where("text IS NOT NULL").groupBy(*keys, "text").agg(F.count("*").alias("c"))
    asked = positions.same(got, sent(batches.where("runs > 1 OR twice").select(source, "batch")), [source, "batch"])
    repeats = each(asked, source, "batch").where("c > 1").groupBy(source).agg(F.count("*").alias("repeats"))
    words = got.groupBy(source, F.expr(f"`{key}` DIV 64").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(`{key}` % 64 AS INT)))").alias("bits"))
    different = words.groupBy(source).agg(F.sum(F.bit_count("bits")).alias("different"))
    few = lambda least: F.col("batches") <= 1.5 * least + 8
    least = F.ceil(F.col("rows") / size)
    # a text's copies are counted only where the rows alone don't ask for as many
    many = positions.same(got, sent(by.where(~few(least)).select(source)), [source])
    most = each(many, source).groupBy(source).agg(F.max("c").alias("most"))
    for other in (repeats, different, most):
        by = positions.same(by, other, [source], "left")
    return by.select(source, "rows", "different", F.coalesce("repeats", F.lit(0).cast("long")).alias("repeats"), "over", few(F.greatest(least, "most")).alias("few"))


def _runs(rows, source: str, hashes: list[str], most: int = 100_000):
    """source, batch, n and twice (whether a hash stands there twice) of each stretch of rows of one batch, as they are read; stretches of over ``most`` rows are cut."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def summed(table: pa.Table, first: np.ndarray):
        n = np.diff(np.append(first, table.num_rows))
        run = np.tile(np.repeat(np.arange(len(first)), n), len(hashes))
        h = np.concatenate([table[c].to_numpy() for c in hashes])
        order = np.lexsort((h, run))
        h, run = h[order], run[order]
        twice = np.zeros(len(first), bool)
        twice[run[1:][(h[1:] == h[:-1]) & (run[1:] == run[:-1])]] = True
        keys = table.select([source, "batch"]).take(pa.array(first))
        return keys.append_column("n", pa.array(n, pa.int64())).append_column("twice", pa.array(twice)).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            code = pc.fill_null(rows[source].combine_chunks().dictionary_encode().indices, -1).to_numpy()
            at = rows["batch"].to_numpy()
            first = np.append(0, np.flatnonzero((np.diff(code) != 0) | (np.diff(at) != 0)) + 1)
            last = first[-1] if rows.num_rows - first[-1] <= most else rows.num_rows
            if last:
                yield from summed(rows.slice(0, last), first[first < last])
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from summed(held, np.zeros(1, np.int64))

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"`{source}` {fields[source]}, batch long, n long, twice boolean")


#: A row leaves the buffer when the next row comes that draws its slot; the rest leave at the end by their hashes.
_BUFFER = """WITH h AS (SELECT {key}, md5({key}::VARCHAR || '#42') AS m FROM {table}),
s AS (SELECT {key}, m, (('0x' || substr(m, 1, 8))::BIGINT % {shards})::INTEGER AS shard, ('0x' || substr(m, 9, 8))::BIGINT % {size} AS draw FROM h),
c AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {key}) - 1 AS came, count(*) OVER (PARTITION BY shard) AS n FROM s),
l AS (SELECT *, lead(came) OVER (PARTITION BY shard, CASE WHEN came < {size} THEN came ELSE draw END ORDER BY came) AS next FROM c)
SELECT {key}, shard, came, CASE WHEN next IS NULL THEN greatest(n - {size}, 0) + row_number() OVER (PARTITION BY shard, next IS NULL ORDER BY m, came) - 1 ELSE next - {size} END AS place FROM l"""


@query("m11_shuffled", _BUFFER.format(key="o_orderkey", table="orders", shards=8, size=1_000))
def shuffled(spark, sf, size: int = 1_000):
    """Every row with the place at which a shuffle buffer gives it; a buffer for each of eight shards."""
    return positions.buffer_shuffled(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", size, shards=8)


@query("m12_rank_shards", f"WITH p AS (SELECT o_orderkey, {_ORDER} AS place, count(*) OVER () AS n FROM orders), a AS (SELECT o_orderkey, place, n FROM p UNION ALL SELECT o_orderkey, place + n, n FROM p WHERE place + n < ceil(n / 4.0) * 4) SELECT o_orderkey, (place % 4)::INTEGER AS rank, place // 4 AS turn FROM a WHERE place // 4 >= 20 + place % 4")
def rank_shards(spark, sf, ranks: int = 4):
    """Shuffled rows dealt to ranks, from the turn at which each rank stopped: its offset is stored and read back."""
    path = folder(spark, "m12")
    spark.range(ranks).select(F.col("id").cast("int").alias("rank"), (F.col("id") + 20).alias("yielded")).write.parquet(path)
    return positions.rank_shards(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", ranks, spark.read.schema("rank int, yielded long").parquet(path))


@query("m14_rows_for_evaluation", "WITH s AS (SELECT doc_id, source, CASE WHEN b < 0.3 THEN 'test' WHEN b < 0.6 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR || '#42'), 1, 8))::BIGINT / 4294967296.0 AS b FROM documents)) SELECT doc_id, split FROM s QUALIFY split = 'train' OR row_number() OVER (PARTITION BY split ORDER BY md5(doc_id::VARCHAR || '#7'), doc_id) <= 50")
def rows_for_evaluation(spark, sf, most: int = 50):
    """Splits for evaluation are cut to some rows drawn by hash; training keeps all."""
    rows = sampling.split_by_hash(t(spark, sf, "documents").select("doc_id"), "doc_id", 0.3, 0.3)
    return rows.where("split = 'train'").unionByName(sampling.capped(rows.where("split <> 'train'"), ["split"], "doc_id", most, seed=7))
