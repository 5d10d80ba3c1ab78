"""Quality classifier: interpolated modified Kneser-Ney over characters (operator 2).

A trigram model of characters is counted on the trusted documents (those with
label quality 1), all of them. Trigrams, bigrams and their continuation counts
are DataFrame aggregates; three discounts for each order come from the counts
of counts. Scoring is a sharded join: every block of documents sends, for each
shard, the distinct trigrams that its documents hold with the documents and
counts; a shard holds the trigrams with its middle characters, their contexts
and the bigrams to back off to, and sends back sums for each document. Shards
are dealt over tasks in several copies of the model, each for a part of the
blocks, so a frequent character is no single task's work, and what the blocks
send grows with the documents.

Perplexity is that of a document's characters, starts and end marked. A
document stays if it isn't over the threshold of its language: a quantile of
the trusted documents' perplexities. A language without trusted
documents takes the threshold of all. Null and empty texts have no perplexity
and go. Documents with equal ids are scored apart. Without any trusted
document nothing can be judged and all documents with text stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmill.llm import common

#: Of 0.9 to 0.999, the one that drops most poor documents while 98 % of held-out trusted ones stay.
QUANTILE = 0.985
#: Groups of middle characters, and copies of each group's part of the model.
SHARDS, COPIES = 8, 8
#: Characters of a block of documents.
BLOCK_CHARS = 4_000_000
START, END = 2, 3  # code points that texts hardly hold; those in a text count as the characters they are
_BITS = 21


def _packed(text: str) -> np.ndarray:
    """Trigrams of a text between its marks, 21 bits a character."""
    code = np.empty(len(text) + 3, np.int64)
    code[:2], code[-1] = START, END
    code[2:-1] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return code[:-2] << 2 * _BITS | code[1:-1] << _BITS | code[2:]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(abc, n): counts of all trigrams of the texts, summed in each step before they are shuffled."""

    def run(batches):
        for batch in batches:
            for b in common.steps(batch):
                grams = [_packed(t) for t in b["text"].to_pylist() if t]
                keys, n = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.record_batch({"abc": pa.array(keys), "n": pa.array(n.astype(np.int64))})

    return common.texts(docs).select("text").mapInArrow(run, "abc long, n long").groupBy("abc").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more; one row comes back."""
    row = counts.select(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [row[f"n{k}"] for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.75 * k for k in (1, 2, 3)]


def _freed(d: list[float]) -> Column:
    """Sum of the discounts, from whole numbers: the same in whatever order rows come."""
    return d[0] * F.count_if(F.col("n") == 1) + d[1] * F.count_if(F.col("n") == 2) + d[2] * F.count_if(F.col("n") > 2)


def _discounted(counts: DataFrame, context, d: list[float]) -> tuple[DataFrame, DataFrame]:
    """(counts with their discounted share of the context, context with the mass left for backing off)."""
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    rows = counts.withColumn("ctx", context).withColumn("off", off)
    by = rows.groupBy("ctx").agg(F.sum("n").alias("total"), _freed(d).alias("freed"))
    share = rows.join(by, "ctx").withColumn("p", (F.col("n") - F.col("off")) / F.col("total"))
    return share, by.select("ctx", (F.col("freed") / F.col("total")).alias("left"))


def model(trusted: DataFrame) -> DataFrame:
    """The model's rows: shard, kind (0 unigram, 1 bigram, 2 context of one, 3 trigram, 4 context of two), key, p.

    p is a final probability for n-grams and the backing-off mass for
    contexts. Unigrams, at most one for each code point, belong to all shards.
    """
    low, mid = F.lit((1 << _BITS) - 1), F.lit((1 << 2 * _BITS) - 1)
    three = common.written(trigram_counts(trusted), "kn-trigrams")
    two = common.written(three.groupBy(F.col("abc").bitwiseAND(mid).alias("bc")).agg(F.count("*").alias("n")), "kn-bigrams")
    one = two.groupBy(F.col("bc").bitwiseAND(low).alias("c")).agg(F.count("*").alias("n"))
    totals = one.agg(F.sum("n").alias("t"), F.count("*").alias("v"))
    # unigrams: a share for each known character, and one more for all unknown ones
    d1 = _discounts(one)
    off = F.when(F.col("n") == 1, d1[0]).when(F.col("n") == 2, d1[1]).otherwise(d1[2])
    freed = one.agg(_freed(d1).alias("f"))
    unigrams = one.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(freed)).select("c", ((F.col("n") - off) / F.col("t") + F.col("f") / F.col("t") / (F.col("v") + 1)).alias("p"))  # one row each
    unknown = totals.crossJoin(F.broadcast(freed)).select(F.lit(-1).cast("long").alias("c"), (F.col("f") / F.col("t") / (F.col("v") + 1)).alias("p"))
    unigrams = common.written(unigrams.union(unknown), "kn-unigrams")
    shares, left1 = _discounted(two, F.shiftright("bc", _BITS), _discounts(two))
    bigrams = shares.join(left1, "ctx").withColumn("c", F.col("bc").bitwiseAND(low)).join(unigrams.withColumnRenamed("p", "p1"), "c").select("bc", (F.col("p") + F.col("left") * F.col("p1")).alias("p"))
    bigrams, left1 = common.written(bigrams, "kn-bigram-p"), common.written(left1, "kn-left1")
    shares, left2 = _discounted(three, F.shiftright("abc", _BITS), _discounts(three))
    trigrams = shares.join(left2, "ctx").withColumn("bc", F.col("abc").bitwiseAND(mid)).join(bigrams.withColumnRenamed("p", "p2"), "bc").select("abc", (F.col("p") + F.col("left") * F.col("p2")).alias("p"))
    shard = lambda b: F.pmod(b, F.lit(SHARDS)).cast("int")
    every = unigrams.select(F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit(0).alias("kind"), F.col("c").alias("key"), "p")
    rows = every.union(bigrams.select(shard(F.shiftright("bc", _BITS)), F.lit(1), "bc", "p"))
    rows = rows.union(left1.select(shard(F.col("ctx")), F.lit(2), "ctx", "left"))
    rows = rows.union(trigrams.select(shard(F.shiftright("abc", _BITS).bitwiseAND(low)), F.lit(3), "abc", "p"))
    rows = rows.union(left2.select(shard(F.col("ctx").bitwiseAND(low)), F.lit(4), "ctx", "left"))
    return common.written(rows.where("p is not null"), "kn-model")  # without any trusted text there is no model


def _bodies(texts: list[str]) -> list[tuple[int, bytes]]:
    """(shard, trigrams with the rows and counts of the texts that hold them) of a block."""
    keys, rows, counts = [], [], []
    for i, t in enumerate(texts):
        if t:
            k, n = np.unique(_packed(t), return_counts=True)
            keys.append(k)
            rows.append(np.full(len(k), i, np.int32))
            counts.append(n.astype(np.int32))
    if not keys:
        return []
    key, row, count = np.concatenate(keys), np.concatenate(rows), np.concatenate(counts)
    shard = (key >> _BITS & (1 << _BITS) - 1) % SHARDS
    order = np.lexsort((key, shard))  # stable: rows stay ascending
    key, row, count = key[order], row[order], count[order]
    cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    out = []
    for s in range(SHARDS):
        k, r, n = (x[cuts[s] : cuts[s + 1]] for x in (key, row, count))
        if len(k):
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            planes = [np.diff(first, append=len(k)).astype("<u4"), np.diff(r, prepend=0).astype("<u4"), n.astype("<u4")]
            tall = b"".join(x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in planes)  # bytes of equal weight side by side
            out.append((s, np.array([len(first), len(k)], "<i8").tobytes() + k[first].tobytes() + tall))
    return out


def _opened(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams, which one each entry is, its row, its count)."""
    m, n = np.frombuffer(body, "<i8", 2).tolist()
    key = np.frombuffer(body, np.int64, m, 16)
    at, got = 16 + 8 * m, []
    for size in (m, n, n):
        got.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4")[:, 0])
        at += 4 * size
    return key, np.repeat(np.arange(m), got[0]), np.cumsum(got[1].view("<i4")), got[2]


def _blocks(docs: DataFrame, copies: int) -> DataFrame:
    """Rows of the join's right side: for each block and shard its trigrams; shard -1 has the block's documents."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in common.steps(batch, limit=BLOCK_CHARS):
                texts = b["text"].to_pylist()
                bodies = _bodies(texts)
                docs_ = {"ids": b["doc_id"].to_pylist(), "hashes": b["hash"].to_pylist(), "sizes": [len(t) + 1 if t else 0 for t in texts]}
                n = len(bodies) + 1
                yield pa.record_batch(
                    {
                        "shard": pa.array([-1, *[s for s, _ in bodies]], pa.int32()),
                        "copy": pa.array([name % copies] * n, pa.int32()),
                        "kind": pa.array([9] * n, pa.int32()),
                        "key": pa.array([name] * n, pa.int64()),
                        "p": pa.array([None] * n, pa.float64()),
                        **{k: pa.array([v] + [None] * (n - 1), pa.list_(pa.int64())) for k, v in docs_.items()},
                        "body": pa.array([None, *[pack.compress(x) for _, x in bodies]], pa.binary()),
                    }
                )
                name += 1

    rows = common.texts(docs).withColumn("hash", F.xxhash64("text"))
    return rows.mapInArrow(run, _ROWS)


_ROWS = "shard int, copy int, kind int, key long, p double, ids array<long>, hashes array<long>, sizes array<long>, body binary"


class _Shard:
    """A shard's part of the model, as sorted arrays."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        kind, key, p = (np.concatenate([np.zeros(0, t), *[x[i] for x in parts]]) for i, t in enumerate((np.int32, np.int64, np.float64)))
        self.of = {}
        for k in range(5):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own])]
            self.of[k] = key[own], p[own]

    def look(self, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each key, whether it is known)."""
        keys, p = self.of[kind]
        if not len(keys):
            return np.ones(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[at] == key
        return np.where(known, p[at], 1.0), known

    def log_p(self, abc: np.ndarray) -> np.ndarray:
        low, mid = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1
        p3, k3 = self.look(3, abc)
        p2, k2 = self.look(1, abc & mid)
        p1, k1 = self.look(0, abc & low)
        p1 = np.where(k1, p1, self.look(0, np.full(1, -1))[0])
        p2 = np.where(k2, p2, self.look(2, abc >> _BITS & low)[0] * p1)
        return np.log(np.where(k3, p3, self.look(4, abc >> _BITS)[0] * p2))


def log_probabilities(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), size (characters and the end) and log_p of each row of docs."""
    copies = max(COPIES, -(-common.partitions(docs.sparkSession) // SHARDS))
    none = lambda t: F.lit(None).cast(t)
    left = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "kind", "key", "p", *[none("array<long>").alias(c) for c in ("ids", "hashes", "sizes")], none("binary").alias("body"))

    def run(batches):
        at, parts, own = None, [], None
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            head = np.stack([batch["shard"].to_numpy(), batch["copy"].to_numpy(), batch["kind"].to_numpy() == 9], axis=1)
            edge = np.concatenate([[0], np.flatnonzero((np.diff(head, axis=0) != 0).any(axis=1)) + 1, [len(head)]])
            for a, z in zip(edge[:-1], edge[1:]):
                shard, copy, block = head[a].tolist()
                if (shard, copy) != at:
                    at, parts, own = (shard, copy), [], None
                b = batch.slice(a, z - a)
                if not block:
                    parts.append(tuple(b[c].to_numpy() for c in ("kind", "key", "p")))
                    continue
                if shard < 0:
                    for name, ids, hashes, sizes in zip(*(b[c].to_pylist() for c in ("key", "ids", "hashes", "sizes"))):
                        n = len(ids)
                        yield _partial(name, np.arange(n), np.zeros(n), ids, hashes, sizes)
                    continue
                own = own or _Shard(parts)
                for name, body in zip(b["key"].to_pylist(), b["body"].to_pylist()):
                    key, which, row, count = _opened(unpack.decompress(body))
                    sums = np.bincount(row, weights=own.log_p(key)[which] * count)
                    some = np.flatnonzero(sums)
                    yield _partial(name, some, sums[some], None, None, None)

    both = left.unionByName(_blocks(docs, copies)).repartition(common.partitions(docs.sparkSession), "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    sums = both.mapInArrow(run, "block long, row long, log_p double, doc_id long, hash long, size long")
    return sums.groupBy("block", "row").agg(F.round(F.sum(F.col("log_p").cast("decimal(38,12)")), 6).cast("double").alias("log_p"), F.max("doc_id").alias("doc_id"), F.max("hash").alias("hash"), F.max("size").alias("size")).drop("block", "row")


def _partial(name, row, log_p, ids, hashes, sizes):
    n = len(row)
    column = lambda x: pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64())
    return pa.record_batch({"block": pa.array([name] * n, pa.int64()), "row": pa.array(row, pa.int64()), "log_p": pa.array(log_p, pa.float64()), "doc_id": column(ids), "hash": column(hashes), "size": column(sizes)})


#: Cells of a value's whole unit in which an exact quantile counts first.
CELLS = 100


def exact_quantile(rows: DataFrame, by: list[str], value: str, quantile: float) -> DataFrame:
    """by and at: the least value that the share ``quantile`` of its group's rows doesn't pass.

    Rows are counted by cell, the running counts of a group's cells find the
    one that holds the quantile, and the counts of that cell's values (of six
    places, so a cell has few) find the value. All are whole numbers: the
    result doesn't depend on how rows are dealt into partitions.
    """
    cell = F.floor(F.col(value) * CELLS)
    rows = rows.select(*by, F.col(value).alias("v__"), cell.alias("cell__"))
    cells = rows.groupBy(*by, "cell__").agg(F.count("*").alias("n__"))
    upto = lambda order: F.sum("n__").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    least = F.greatest(F.lit(1), F.ceil(F.sum("n__").over(Window.partitionBy(*by)) * F.lit(quantile) - 1e-9))
    found = cells.select(*by, "cell__", "n__", upto("cell__").alias("upto__"), least.alias("least__")).where("upto__ >= least__ AND upto__ - n__ < least__")
    found = found.select(*[F.col(c).alias(f"{c}_of__") for c in by], F.col("cell__").alias("at__"), (F.col("least__") - F.col("upto__") + F.col("n__")).alias("rest__"))
    same = F.col("cell__") == F.col("at__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of__"))
    values = rows.join(found, same).groupBy(*by, "v__", "rest__").agg(F.count("*").alias("n__"))
    values = values.select(*by, "v__", "n__", "rest__", upto("v__").alias("upto__"))
    return values.where("upto__ >= rest__ AND upto__ - n__ < rest__").select(*by, F.col("v__").alias("at"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, hash, lang, log_p, perplexity, threshold and kept of each row of docs.

    labels: doc_id and quality; documents with quality 1 are trusted. docs may
    hold further columns.
    """
    good = common.written(labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "kn-good")
    good = F.broadcast(good) if good.count() <= common.SENT_ROWS else good  # beyond the check both sides are shuffled
    trusted = docs.join(good, "doc_id", "left_semi")
    scored = common.written(log_probabilities(docs, model(trusted)), "kn-scored")
    perplexity = F.when(F.col("size") > 0, F.exp(-F.col("log_p") / F.col("size")))
    langs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "lang").distinct()
    of = scored.select("doc_id", "hash", "log_p", F.round(perplexity, 6).alias("perplexity")).distinct()
    rows = langs.join(of, langs["doc_id"].eqNullSafe(of["doc_id"]) & (langs["hash"] == of["hash"])).select(langs["doc_id"], langs["hash"], "lang", "log_p", "perplexity")
    sure = rows.join(good, "doc_id", "left_semi").where("perplexity is not null")
    by = exact_quantile(sure, ["lang"], "perplexity", quantile).withColumnRenamed("at", "own")  # a row for each language
    everywhere = exact_quantile(sure.withColumn("all", F.lit(0)), ["all"], "perplexity", quantile).select(F.max("at").alias("any"))
    rows = rows.join(by, rows["lang"].eqNullSafe(by["lang"]), "left").drop(by["lang"]).crossJoin(F.broadcast(everywhere))  # one row
    threshold = F.coalesce("own", "any")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return rows.select("doc_id", "hash", "lang", "log_p", "perplexity", F.round(threshold, 6).alias("threshold"), kept.alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "lang", "log_p", "perplexity", "threshold", "kept")
