"""Document fingerprints: one-permutation MinHash (operator 1).

Every shingle hash falls into one of BINS bins by its top bits and each bin
keeps its least value, so a text is hashed once. An empty bin takes the value
of the first filled bin in its own random order of all bins (optimal
densification). Of every bin's value BITS low bits are kept, packed, as hex.
Likeness corrects the share of equal bins for the 2**-BITS that agree by
chance.

A null text counts as empty. A text without words has the fingerprint of
zeros and a leading 0; two such texts have likeness 1, and one such against
any other text 0. Equal texts have equal fingerprints. Repeated ids and rows
give a row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common
from pairmill.llm.shingles import mix, shingle_hashes

BINS, BITS, WIDTH = 512, 4, 5
_ORDER: list[np.ndarray] = []


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it asks the others, and its inverse."""
    if not _ORDER:
        key = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0xD5)).reshape(BINS, BINS)
        order = np.argsort(key, axis=1).astype(np.int16)
        _ORDER.extend([order, np.argsort(order, axis=1).astype(np.int16)])
    return _ORDER[0], _ORDER[1]


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(low bits of each text's bins, uint8; whether the text has words)."""
    n = len(texts)
    hashes, offs = shingle_hashes(texts, WIDTH)
    size = np.diff(offs)
    none = np.uint64(2**64 - 1)
    least = np.full(n * BINS, none)
    bits = BINS.bit_length() - 1
    rows = np.repeat(np.arange(n, dtype=np.int64), size)
    np.minimum.at(least, rows * BINS + (hashes >> np.uint64(64 - bits)).astype(np.int64), hashes & np.uint64(2 ** (64 - bits) - 1))
    least = least.reshape(n, BINS)
    filled = least != none
    order, place = _orders()
    some = filled.any(axis=1)
    many = filled.sum(axis=1) > 24
    doc, hole = np.nonzero(~filled & (some & many)[:, None])
    for k in range(BINS):
        if not len(doc):
            break
        ask = order[hole, k]
        ok = filled[doc, ask]
        least[doc[ok], hole[ok]] = least[doc[ok], ask[ok]]
        doc, hole = doc[~ok], hole[~ok]
    for i in np.flatnonzero(some & ~many):
        have = np.flatnonzero(filled[i])
        nearest = have[np.argmin(place[:, have], axis=1)]
        least[i] = least[i, nearest]
    low = (mix(least) & np.uint64(2**BITS - 1)).astype(np.uint8)
    low[~some] = 0
    return low, some


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Hex of the bins' bits, two bins a byte, after 1 (words) or 0 (none)."""
    both = (low[:, 0::2] << 4 | low[:, 1::2]).astype(np.uint8)
    return [f"{int(s)}{row.tobytes().hex()}" for row, s in zip(both, some)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1, corrected for chance."""
    chance = 2.0**-BITS
    got = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, got, (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each text; row-local."""

    def run(batches):
        for batch in batches:
            for b in common.steps(batch):
                low, some = sketches(b["text"])
                yield pa.record_batch({"doc_id": b["doc_id"], "n_chars": pa.array([len(t) for t in b["text"].to_pylist()], pa.int64()), "fingerprint": pa.array(packed(low, some))})

    return common.texts(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _ranged(docs: DataFrame) -> DataFrame:
    """Ranges of ids, each sorted down, with the first row of the next range below as a peek row.

    The ranges come from quantiles of the ids alone; the texts move once. At
    the lowest range the peek row is the first of all.
    """
    spark = docs.sparkSession
    n = common.partitions(spark) * 3
    ids = docs.select("doc_id").where("doc_id is not null")
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="range", handleInvalid="keep") if cuts else None

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("at", F.col("doc_id").cast("double"))
        df = bucket.transform(df) if bucket else df.withColumn("range", F.lit(0))
        return df.withColumn("range", F.coalesce(F.col("range"), F.lit(-1)).cast("int")).drop("at")

    tops = sorted((r["range"], r["top"]) for r in placed(docs.select("doc_id")).groupBy("range").agg(F.max("doc_id").alias("top")).collect())  # a row for each range
    goes = [(r, top, tops[(i + 1) % len(tops)][0]) for i, (r, top) in enumerate(tops)]
    near = spark.createDataFrame(goes, "range int, top long, to int")  # a row for each range: bounded by the partitions
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("peek"))
    there = F.struct(F.col("to").alias("range"), F.lit(1).alias("peek"))
    tall = F.col("doc_id").eqNullSafe(F.col("top"))
    rows = placed(common.texts(docs)).join(F.broadcast(near), "range").withColumn("dealt", F.explode(F.when(tall, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select(F.col("dealt.range").alias("range"), F.col("dealt.peek").alias("peek"), "doc_id", "text")
    return rows.repartition(common.partitions(spark), "range").sortWithinPartitions("range", "peek", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has the last third of the code points replaced by as many
    first ones of the next document, descending doc_id (of equal ids by text,
    ids that are null last; after the last the first).
    """

    def joined(group: list[tuple[int, str]], peek: str):
        ids = [i for i, _ in group]
        whole = [t for _, t in group]
        after = [*whole[1:], peek]
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(whole, after)]
        low, some = sketches(pa.array([*whole, peek], pa.large_string()))
        elow, esome = sketches(pa.array(edited, pa.large_string()))
        return pa.record_batch(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in whole], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                "fingerprint": pa.array(packed(low[:-1], some[:-1])),
                "edited_fingerprint": pa.array(packed(elow, esome)),
                "near_edited": pa.array(likeness(low[:-1], some[:-1], elow, esome)),
                "near_next": pa.array(likeness(low[:-1], some[:-1], low[1:], some[1:])),
            }
        )

    def run(batches):
        held: list[tuple[int, str]] = []
        at, chars, peeked = None, 0, False
        for batch in batches:
            for rng, peek, doc, text in zip(*(batch[c].to_pylist() for c in ("range", "peek", "doc_id", "text"))):
                if rng != at:
                    at, peeked = rng, False
                if peek and peeked:
                    continue
                peeked = bool(peek)
                if peek:
                    if held:
                        yield joined(held, text)
                    held, chars = [], 0
                    continue
                if chars > common.STEP_CHARS // 2:
                    yield joined(held, text)
                    held, chars = [], 0
                held.append((doc, text))
                chars += len(text)

    return _ranged(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.documents(spark, sf_dir))
