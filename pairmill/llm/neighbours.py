"""Approximate nearest neighbours by a permutation index (operator 10).

PIVOTS vectors, a bounded sample by hash of the ids, are the pivots. Every
vector is represented by its DEPTH nearest pivots in order and posted, with
the pivot's place in that order, in each one's inverted file. A query reads
the files of its own nearest pivots; footrule distance (a pivot missing from a
list has place DEPTH) ranks what it finds, and the best CANDIDATES different
vectors of a block of rows are reranked by exact cosine. Blocks of rows meet blocks of queries in
tasks of bounded size, and each gives its best for every query.

Vectors that are null, zero, of another length than the pivots, or hold null
or non-finite components take no part. Ties go to the smaller vec_id. Repeated
ids are rows of their own, but no row with the query's id is its neighbour; an
id asks once, with the least of its vectors.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmill.llm import common

PIVOTS, DEPTH, CANDIDATES = 256, 96, 1_000
#: Rows and queries that one task's block holds on average.
ROWS, QUERIES = 8_192, 2_048
SEED = 11


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    v = F.col("v")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, fine) & F.exists(v, lambda x: x != 0))


def pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Directions of n vectors of a bounded sample, no two nearly alike; the commonest length goes."""
    found = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(16 * n).collect()
    sizes = [len(r["v"]) for r in found]
    if not sizes:
        return np.zeros((0, 0))
    width = max(set(sizes), key=lambda s: (sizes.count(s), -s))
    own = np.array([r["v"] for r in found if len(r["v"]) == width])
    own = own / np.abs(own).max(axis=1, keepdims=True)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    taken = np.empty((0, width))
    for alike in (0.8, 2.0):  # nearly like ones only where there are too few others
        for x in own:
            if len(taken) < n and not (taken @ x > alike).any() and not (taken == x).all(axis=1).any():
                taken = np.vstack([taken, x])
    return taken


def places(vectors: np.ndarray, pivot: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = (vectors / np.abs(vectors).max(axis=1, keepdims=True)) @ pivot.T
    return np.argsort(-near, axis=1, kind="stable")[:, :depth]


def inverted(own: np.ndarray, count: int) -> np.ndarray:
    """(pivots, rows) each pivot's file: its place in every row's list, the lists' length where it has none."""
    depth = own.shape[1]
    files = np.full((count, len(own)), depth, np.int16)
    files[own, np.arange(len(own))[:, None]] = np.arange(depth, dtype=np.int16)[None, :]
    return files


def footrule(files: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """(queries, rows) footrule distances; only the files of a query's own pivots are read.

    All lists are equally long, so the places of pivots that only a row has are
    a constant less those of the pivots that the query shares with it.
    """
    depth = lists.shape[1]
    own = np.arange(depth, dtype=np.int16)[:, None]
    out = np.empty((len(lists), files.shape[1]), np.int32)
    for q, pivots_ in enumerate(lists):
        read = files[pivots_]
        out[q] = (np.abs(read - own) + read).sum(axis=0, dtype=np.int32)
    return out - depth * depth + depth * (depth + 1) // 2


def cosine(rows: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", rows, query) / (norms * np.sqrt(np.einsum("j,j->", query, query)))


def search(vectors: DataFrame, every: int = 50, k: int = 5, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row whose id every divides."""
    spark = vectors.sparkSession
    rows = common.written(_usable(vectors), "ann-rows")
    pivot = pivots(rows)
    width, count = (pivot.shape[1] if len(pivot) else 0), len(pivot)
    depth = min(DEPTH, count)
    rows = rows.where(F.size("v") == width)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asked.count()
    nb, qb = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    block = lambda b, *c: F.pmod(F.xxhash64(*c, F.lit(SEED + 1)), F.lit(b)).cast("int")
    left = rows.select(block(nb, "vec_id", "v").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"), F.lit(0).alias("kind"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"), block(qb, "vec_id").alias("q"), F.lit(1).alias("kind"), "vec_id", "v")

    def best(ids, v, qids, qv):
        by_id = np.argsort(ids, kind="stable")
        ids, v = ids[by_id], v[by_id]
        raw = np.ascontiguousarray(v + 0.0).view(f"V{8 * width}")[:, 0]  # equal vectors are one
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        start = np.searchsorted(which[order], np.arange(len(first) + 1))
        one = v[first]
        norms = np.sqrt(np.einsum("ij,ij->i", one, one))
        files, lists = inverted(places(one, pivot, depth), count), places(qv, pivot, depth)
        out: list[tuple] = []
        take = min(candidates, len(one))
        for at in range(0, len(qids), 128):
            far = footrule(files, lists[at : at + 128])
            for q, d in zip(range(at, min(at + 128, len(qids))), far):
                near = np.argpartition(d, take - 1)[:take]
                score = cosine(one[near], norms[near], qv[q])
                if take > 2 * k:
                    some = score >= np.partition(score, take - k - 1)[take - k - 1]
                    near, score = near[some], score[some]
                got = [(-c, i) for u, c in zip(near.tolist(), score.tolist()) for i in ids[order[start[u] : min(start[u + 1], start[u] + k + 1)]].tolist() if i != qids[q]]
                out += [(int(qids[q]), i, -c) for c, i in sorted(got)[:k]]
        return pa.record_batch({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    def run(batches):
        at, held = None, ([], [], [], [])

        def done():
            ids, v, qids, qv = held
            if ids and qids:
                yield best(np.array(ids, np.int64), np.concatenate(v), np.array(qids, np.int64), np.concatenate(qv))

        for batch in batches:
            key = np.stack([batch["b"].to_numpy(), batch["q"].to_numpy(), batch["kind"].to_numpy()], axis=1)
            edge = np.concatenate([[0], np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1, [len(key)]])
            for a, z in zip(edge[:-1], edge[1:]):
                b, q, kind = key[a].tolist()
                if (b, q) != at:
                    yield from done()
                    at, held = (b, q), ([], [], [], [])
                part = batch.slice(a, z - a)
                held[2 * kind].extend(part["vec_id"].to_pylist())
                held[2 * kind + 1].append(part["v"].flatten().to_numpy().reshape(z - a, width))
        yield from done()

    both = left.unionByName(right).repartition(max(common.partitions(spark), 1), "b", "q").sortWithinPartitions("b", "q", "kind")
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
