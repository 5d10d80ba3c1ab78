"""Exact top-k search in blocks: one matrix product for each pair of blocks.

Queries and corpus rows of a data set are dealt over blocks by a hash of their
ids. Every query block meets every corpus block in one group of rows: the
queries come first and become a matrix, the corpus streams past it in Arrow
batches, and the group gives the k best of each of its queries. A task holds a
block of queries, one batch of the corpus and their scores, whatever the sizes
of the tables; a window over k rows for each pair of blocks ends the search.

Scores are rounded to six places; ties go to the larger id. Rows whose vector
is null, empty or holds null or non-finite numbers, and zero vectors under
cosine, take no part; nor do rows whose dimension is another one than that of
the block's queries. Queries without any corpus row give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query block, of a corpus block, corpus rows of one product, and its scores: with their copies they are what a worker holds.
QUERY_ROWS, CORPUS_ROWS, STEP, CELLS = 1_000, 50_000, 2_000, 250_000
SCORES = ("cosine", "dot", "manhattan", "euclidean", "hamming")


def _prepared(m: np.ndarray, score: str) -> np.ndarray:
    if score == "cosine":
        return m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(m >= 0, 1.0, -1.0) if score == "hamming" else m


def _scores(q: np.ndarray, c: np.ndarray, score: str) -> np.ndarray:
    if score in ("cosine", "dot"):
        return q @ c.T
    if score == "hamming":  # signs that agree
        return (q.shape[1] + q @ c.T) / 2
    out = np.zeros((len(q), len(c)))
    for x, y in zip(q.T, c.T):
        gap = x[:, None] - y[None, :]
        out += np.abs(gap, out=gap) if score == "manhattan" else np.multiply(gap, gap, out=gap)
    return -(out if score == "manhattan" else np.sqrt(out))


class Kept:
    """The k best corpus rows of each of n queries, ties to the larger id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.at, self.to = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)  # below this no row can be among a query's best

    def keep(self, ids: np.ndarray, got: np.ndarray) -> None:
        """More rows: got has a row of scores for each query, -inf where there is no hit."""
        if got.shape[1] > self.k:
            self.least = np.maximum(self.least, np.partition(got, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((got >= self.least[:, None]) & (got > -np.inf))
        row, at, to = np.concatenate([self.row, row]), np.concatenate([self.at, got[row, col]]), np.concatenate([self.to, ids[col]])
        order = np.lexsort((-to, -at, row))
        row, at, to = row[order], at[order], to[order]
        first = np.searchsorted(row, np.arange(self.n))
        keep = np.arange(len(row)) - first[row] < self.k
        self.row, self.at, self.to = row[keep], at[keep], to[keep]


class _Best(Kept):
    """The k best of a block's queries by their vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, score: str, apart: bool):
        super().__init__(len(ids), k)
        self.ids, self.q, self.score, self.apart = ids, _prepared(matrix, score), score, apart

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        got = np.round(_scores(self.q, _prepared(matrix, self.score), self.score), 6) + 0.0
        if self.apart:
            got[self.ids[:, None] == ids[None, :]] = -np.inf
        self.keep(ids, got)


def product_rows(queries: int) -> int:
    """Corpus rows that meet so many queries in one product."""
    return max(1, min(STEP, CELLS // max(1, queries)))


def _matrix(column: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of vectors of one size, the matrix of them)."""
    offs, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    length = np.diff(offs)
    size = (int(length[0]) if len(length) else 0) if size is None else size
    rows = np.flatnonzero(length == size)
    return rows, flat[offs[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))


def _sound(df: DataFrame, vector: str, score: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    df = df.withColumn(vector, v.cast("array<double>")).where(v.isNotNull() & (F.size(v) > 0) & finite)
    return df.where(F.exists(v, lambda x: x != 0)) if score == "cosine" else df


def _dealt(df: DataFrame, id_: str, by: list[str], rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(df with its block in name, number of blocks of each data set in n_name)."""
    n = df.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias(f"n_{name}"))
    block = F.pmod(F.xxhash64(id_), F.col(f"n_{name}")).cast("int").alias(name)
    return df.join(F.broadcast(n) if not by else n, by or None, "inner" if by else "cross").select(*df.columns, block), n  # one row where there is one set


def top_k(queries: DataFrame, corpus: DataFrame, score: str, k: int, by: list[str] = [], apart: bool = False) -> DataFrame:
    """by, query_id, corpus_id, score and rank of the k best corpus rows of each query.

    queries: query_id, qv; corpus: corpus_id, cv; both with the columns ``by``
    that tell data sets apart. apart: a query doesn't find its own id.
    """
    if score not in SCORES:
        raise ValueError(f"score has to be one of {SCORES}")
    q, n_q = _dealt(_sound(queries.select(*by, "query_id", "qv"), "qv", score), "query_id", by, QUERY_ROWS, "i")
    c, n_c = _dealt(_sound(corpus.select(*by, "corpus_id", "cv"), "cv", score), "corpus_id", by, CORPUS_ROWS, "j")
    meets = lambda df, n: df.join(n if by else F.broadcast(n), by or None, "inner" if by else "cross")  # noqa: E731  a row for each data set
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = meets(q, n_c).select(*by, "i", every("n_j").alias("j"), F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("qv").alias("v"))
    right = meets(c, n_q).select(*by, every("n_i").alias("i"), "j", F.lit(1).alias("side"), F.col("corpus_id").cast("long").alias("id"), F.col("cv").alias("v"))
    group = [*by, "i", "j"]
    rows = left.unionByName(right)
    key = F.xxhash64(*group)
    rows = rows.select(key.alias("group__"), *by, "side", "id", "v", "i", "j")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema) + (", " if by else "") + "query_id long, corpus_id long, score double"

    def run(batches):
        at, best, waiting = None, None, []

        def opened():
            rows, matrix = _matrix(pa.concat_arrays([x.column("v") for x in waiting]), None)
            ids = np.concatenate([x.column("id").to_numpy() for x in waiting])[rows]
            return _Best(ids, matrix, k, score, apart)

        def closed():
            if best is not None and len(best.row):
                head = {c: pa.array([v] * len(best.row), t) for c, (v, t) in at[1].items()}
                yield pa.record_batch({**head, "query_id": pa.array(best.ids[best.row]), "corpus_id": pa.array(best.to), "score": pa.array(best.at)})

        for batch in batches:
            head = np.stack([batch["group__"].to_numpy(), batch["i"].to_numpy(), batch["j"].to_numpy(), batch["side"].to_numpy()], axis=1)
            edge = np.concatenate([[0], np.flatnonzero((np.diff(head, axis=0) != 0).any(axis=1)) + 1, [len(head)]])
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own, part = tuple(head[a, :3].tolist()), batch.slice(a, z - a)
                if at is None or own != at[0]:
                    yield from closed()
                    at, best, waiting = (own, {c: (part[c][0].as_py(), part[c].type) for c in by}), None, []
                if head[a, 3] == 0:
                    waiting.append(part)
                    continue
                if best is None and waiting:
                    best, waiting = opened(), []
                if best is None:
                    continue
                some = product_rows(len(best.ids))
                for b in range(0, part.num_rows, some):
                    step = part.slice(b, some)
                    rows, matrix = _matrix(step["v"], best.q.shape[1])
                    if len(rows):
                        best.add(step["id"].to_numpy()[rows], matrix)
        yield from closed()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "group__").sortWithinPartitions("group__", "i", "j", "side", "id").mapInArrow(run, schema)
    order = Window.partitionBy(*by, "query_id").orderBy(F.col("score").desc(), F.col("corpus_id").desc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
