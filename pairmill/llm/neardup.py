"""Near-duplicate documents by min-max hashing (operator 7).

A text's set holds the hashes of its distinct word shingles. Under each of
PERMUTATIONS permutations both the least and the greatest element are kept, so
one evaluation gives two signature values; ROWS values make a band, and texts
that agree in a band are candidates. At a likeness of 0.8 a pair escapes all
bands with a chance of about 3e-6.

Texts with equal sets (by 128-bit digests) form a class, and classes are what
is banded. The two classes of a bucket that holds no others are a pair, which
is tried on full sets: at most BANDS of them for a class. In each of ROUNDS
rounds every class of a larger bucket that still holds several components is
tried against one centre: the one that most of its buckets have. So a round
tries few pairs for each class, however large a group is; a centre's set is
sent once for each PART of its classes. Linked classes become one component,
and the next round has other centres. The classes of larger buckets that then
still hold several components meet in blocks of bounded size, bucket by bucket
(equal buckets once), where those of different components are compared on full
sets; a task gives only the links that join components. So no bucket is cut
and none is expanded into rows of pairs, and every two candidates are in one
component or were compared: in a bucket of two in the first round, in a larger
one at last in a block.

Texts without words (null and empty ones too) are linked with nothing.
Repeated ids and rows are documents of their own; a component's id is the
least id in it, a null id only where it has no other. Of each component the
row with that id stays, of several such rows the one with the least text hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common
from pairmill.llm.components import components
from pairmill.llm.shingles import mix, shingle_hashes

PERMUTATIONS, ROWS, BANDS = 80, 5, 32
#: Rounds of centres before what is left of the buckets is compared in blocks.
ROUNDS = 2
#: Classes that are tried against one copy of their centre's set.
PART = 1_000
#: Set elements of one side that a task compares at once, on average.
ELEMENTS = 1_500_000
_rng = np.random.default_rng(0x317A)
_FACTOR = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMAND = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)
_FOLD = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, offs = shingle_hashes(texts, width)
    return [np.unique(hashes[offs[i] : offs[i + 1]]) for i in range(len(texts))]


def class_of(own: np.ndarray) -> bytes | None:
    """Class of a set: a 128-bit digest of its elements; none for the empty set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS) least and greatest values under each permutation; sets have elements."""
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        moved = flat * _FACTOR[k] + _SUMMAND[k]
        out[:, 2 * k] = np.minimum.reduceat(moved, start)
        out[:, 2 * k + 1] = np.maximum.reduceat(moved, start)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys; the band's number is part of its key."""
    parts = mix(signature).reshape(len(signature), BANDS, ROWS)
    return mix((parts * _FOLD).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, class and band keys of each text."""

    def run(batches):
        for batch in batches:
            for b in common.steps(batch):
                sets = shingle_sets(b["text"], width)
                some = [s for s in sets if len(s)]
                sig = signatures(some) if some else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
                keys = iter(band_keys(sig).tolist())
                yield pa.record_batch(
                    {
                        "doc_id": b["doc_id"],
                        "hash": b["hash"],
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "cls": pa.array([class_of(s) for s in sets], pa.binary()),
                        "bands": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    }
                )

    rows = common.texts(docs).withColumn("hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, hash long, n_shingles long, cls binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, elements) of the wanted classes, read from the text of each one's least row. wanted: node, cls, low and low_hash."""

    def run(batches):
        for batch in batches:
            for b in common.steps(batch):
                sets = shingle_sets(b["text"], width)
                yield pa.record_batch({"node": b["node"], "want": b["cls"], "cls": pa.array([class_of(s) for s in sets], pa.binary()), "elements": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    texts = common.texts(docs).withColumn("hash", F.xxhash64("text"))
    texts = texts.join(wanted.select("low", "low_hash", "cls", "node"), F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("hash") == F.col("low_hash")))
    found = texts.select("node", "cls", "text").mapInArrow(run, "node long, want binary, cls binary, elements array<long>")
    return found.where("want = cls").select("node", "elements").dropDuplicates(["node"])  # rows may repeat


def _enough(both: int, x: int, y: int, percent: int) -> bool:
    return both * 100 >= (x + y - both) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the likeness; a is a centre.

    The classes of a centre are dealt into parts of about PART; each part
    holds one copy of the centre's set, and its classes' sets stream past it.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    members = pairs.join(parts, "a").select("a", part, F.col("b").alias("node"), F.lit(1).alias("kind"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("kind"))
    rows = members.union(centres).join(sets, "node").select("a", "part", "kind", "node", "elements")

    def run(batches):
        at, own = None, None
        for batch in batches:
            left, right = [], []
            elements = batch["elements"]
            for i, (a, part, kind, node) in enumerate(zip(*(batch[c].to_pylist() for c in ("a", "part", "kind", "node")))):
                other = elements[i].values.to_numpy().view(np.uint64)  # the order in which sets are sorted
                if kind == 0:
                    at, own = (a, part), other.copy()
                elif at == (a, part):
                    where = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    if _enough(int((own[where] == other).sum()), len(own), len(other), percent):
                        left.append(a)
                        right.append(node)
            yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    n = common.partitions(rows.sparkSession)
    return rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(run, "a long, b long")


def _linked(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between components among the classes (node, label, elements) of one bucket, by full sets; enough of them to join what belongs together.

    right empty: among left itself.
    """
    rows = left + right
    cls = [r[0] for r in rows]
    root = np.array([r[1] for r in rows], np.int64)
    size = np.array([len(r[2]) for r in rows], np.int64)
    local = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mark = np.zeros(int(local.max()) + 1, bool)
    out = []
    for x in range(len(left)):
        first = len(left) if right else x + 1
        near = first + np.flatnonzero(root[first:] != root[x])
        near = near[np.minimum(size[near], size[x]) * 100 >= np.maximum(size[near], size[x]) * percent]
        if not len(near):
            continue
        own = local[start[x] : start[x] + size[x]]
        mark[own] = True
        upto = np.cumsum(size[near]) - size[near]
        at = np.repeat(start[near] - upto, size[near]) + np.arange(size[near].sum())
        both = np.add.reduceat(mark[local[at]], upto, dtype=np.int64)
        mark[own] = False
        for y in near[both * 100 >= (size[near] + size[x] - both) * percent]:
            if root[y] != root[x]:
                out.append((cls[x], cls[y]))
                root[root == root[y]] = root[x]
    return out


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket. members: bucket, node, label, blocks.

    A bucket's classes are dealt into blocks of about ELEMENTS set elements,
    and every two blocks meet in a task, where classes of different components
    are compared.
    """
    rows = members.join(sets, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "elements")

    def run(batches):
        at, left, right = None, [], []

        def done():
            if left and (right or at[1] == at[2]):
                found = _linked(left, right, percent)
                yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        for batch in batches:
            elements = batch["elements"]
            for k, (bucket, i, j, own, node, label) in enumerate(zip(*(batch[c].to_pylist() for c in ("bucket", "i", "j", "own", "node", "label")))):
                if (bucket, i, j) != at:
                    yield from done()
                    at, left, right = (bucket, i, j), [], []
                (left if own == i else right).append((node, label, elements[k].values.to_numpy().copy()))
        yield from done()

    dealt = rows.repartition(common.partitions(rows.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _open(crowded: DataFrame, labels: DataFrame, order, least: int) -> DataFrame:
    """Classes of the buckets of over ``least`` classes that hold several components: bucket, node, n, m, label, and each bucket's centre: the first in order.

    Of buckets with the same classes one is taken.
    """
    placed = crowded.where(F.col("m") > least).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    centre = F.min(F.struct(order.alias("o"), F.col("node").alias("center"), F.col("n").alias("cn"), F.col("label").alias("cl"))).alias("c")
    same = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(30,0)")).alias(f"s{k}") for k in (0, 1)]
    by = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), centre, F.sum("n").alias("weight"), *same).where("x <> y")
    one = by.groupBy("s0", "s1").agg(F.min(F.struct("bucket", "c", "weight")).alias("one")).select("one.bucket", "one.c.center", "one.c.cn", "one.c.cl", "one.weight")
    return placed.join(one, "bucket").select("bucket", "node", "n", "m", "label", "center", "cn", "cl", "weight")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, name: str = "neardup") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the id is the component's), hash (of the text) and stays of each document.

    stays is true for the one row (with its repetitions) that stands for its component.

    Documents are linked when 100 * common shingles >= percent * all shingles of the two.
    """
    each = common.written(described(docs, width), f"{name}-each")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")  # null ids last
    classes = each.where("cls is not null").groupBy("cls").agg(least, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # a class's number is unique and stays what it is once the table is written
    classes = common.written(classes.select(F.monotonically_increasing_id().alias("node"), "cls", F.col("least.doc_id").alias("low"), F.col("least.hash").alias("low_hash"), "n", "bands"), f"{name}-classes")
    banded = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    crowded = common.written(banded.join(buckets, "bucket").select("bucket", "node", "n", "m"), f"{name}-crowded")
    wanted = classes.select("node", "cls", "low", "low_hash").join(crowded.select("node").distinct(), "node")
    sets = common.written(_sets(docs, wanted, width), f"{name}-sets")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    close = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent
    for k in range(ROUNDS):
        order = F.col("node") if k == 0 else F.xxhash64("node", F.lit(k))
        tried = _open(crowded, labels, order, 1 if k == 0 else 2).where((F.col("label") != F.col("cl")) & close)
        pairs = tried.where("m > 2").groupBy(F.col("node").alias("b")).agg(F.mode("center", True).alias("a")).select("a", "b")
        if k == 0:  # each bucket of two is settled here
            pairs = pairs.union(tried.where("m = 2").select(F.col("center").alias("a"), F.col("node").alias("b"))).distinct()
        pairs = common.written(pairs, f"{name}-pairs")
        links = links.union(common.written(_confirmed(pairs, sets, percent), f"{name}-links"))
        labels = common.written(components(links, f"{name}-{k}"), f"{name}-labels")
        common.dropped(pairs)
    left = _open(crowded, labels, F.col("node"), 2)
    members = common.written(left.select("bucket", "node", "label", F.ceil(F.col("weight") / ELEMENTS).cast("int").alias("blocks")), f"{name}-left")
    if not members.isEmpty():
        links = links.union(common.written(_rest(members, sets, percent), f"{name}-more"))
        labels = common.written(components(links, f"{name}-last"), f"{name}-labels")
    low = classes.select("node", "cls", "low", "low_hash").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = low.groupBy("label").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "low_hash")).alias("first"))
    ids = common.written(low.join(first, "label").select("cls", F.col("first.low").alias("component_id"), F.col("first.low_hash").alias("first_hash")), f"{name}-ids")
    common.dropped(classes, crowded, sets, members)
    own = each.select("doc_id", "hash", "n_shingles", "cls").join(ids, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    stays = kept & (F.col("cls").isNull() | (F.col("hash") == F.col("first_hash")))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "hash", stays.alias("stays"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the least id and text hash, of its repetitions the least row."""
    found = common.written(near_duplicates(docs, width, percent, "dedup"), "dedup-found")
    rows = common.decided(docs, found.where(~F.col("stays")).select("doc_id", "hash").distinct(), "left_anti")
    again = found.where(F.col("stays") & (F.col("n_shingles") > 0)).groupBy("doc_id", "hash").count().where("count > 1")
    if again.isEmpty():
        return rows
    again = common.written(again.select("doc_id", "hash"), "dedup-again")
    some = common.keyed(common.decided(rows, again, "left_semi"))
    one = some.groupBy("doc_id", "pm_hash__").agg(F.min(F.struct(*docs.columns)).alias("pm_row__")).select("pm_row__.*")
    return common.decided(rows, again, "left_anti").unionByName(one)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), width=4, name="op7").drop("hash", "stays")


#: Links on distinct texts' full sets, found through shared shingles; components by least id.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END)) AS s FROM w
), c AS (SELECT md5(array_to_string(s, chr(10))) AS cls, min(doc_id) AS low, any_value(s) AS s, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT low, n, unnest(s) AS g FROM c),
link AS (
  SELECT a.low AS a, b.low AS b FROM e a JOIN e b ON a.g = b.g AND a.low < b.low
  GROUP BY a.low, b.low, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, label) AS (SELECT low, low FROM c UNION SELECT pair.b, reach.label FROM reach JOIN pair ON pair.a = reach.node),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.label, s.doc_id) AS component_id, s.doc_id = coalesce(comp.label, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.cls = md5(array_to_string(s.s, chr(10))) LEFT JOIN comp ON comp.node = c.low
"""
