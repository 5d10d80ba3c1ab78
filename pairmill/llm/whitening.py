"""Whitening of embeddings by a tall, thin SVD (operator 12).

Entries c become whole numbers x = floor(64 c) + 1,000,000; the fit list is
every distinct x vector once. Its sums are exact whole numbers, and rows are
centred exactly before they turn into doubles. Tasks compress their centred
rows block by block to a triangle R (QR of the block under the R so far), and
triangles are merged in a tree until one is left: X'X = R'R without ever
forming a product of rows. One-sided Jacobi on R turns pairs of columns until
all are orthogonal: the columns' lengths are the singular values, accurate to
their last digits even for small ones, and the accumulated turns are the
components. A component's greatest entry by size is positive.

Every step holds one block of rows and a few matrices of the vectors'
dimension. Nothing but a component table of at most 16 rows comes to the
driver and goes to all tasks.

Rows whose vector is null or holds null or non-finite entries are dropped.
The dimension is the most frequent length of the others (of ties the greater);
vectors of another length, and empty ones, are dropped. Entries whose x passes
2^53 count as 2^53. Repeated ids and rows are rows of their own. Components of
no variance (below rounding) can't be whitened and give no rows: with one
distinct vector there are none. A deviation over a long is null. An empty
table gives no rows; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common

COMPONENTS = 16
SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0**53
#: Rows of a block that is compressed at once; states that one task merges.
ROWS, FAN = 4_096, 16
_STATE = "part long, state binary"


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that take part, their whole numbers)."""
    column = column.cast(pa.list_(pa.float64()))
    offs, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((np.diff(offs) == size) & ~column.is_null().to_numpy(zero_copy_only=False))
    c = flat[offs[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    sound = np.isfinite(c).all(axis=1)
    x = np.floor(SCALE * c[sound])
    return rows[sound], np.clip(x, -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _read(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["x"].to_pylist()), np.int64).reshape(-1, size)


def reduced(states: DataFrame, merge: Callable[[bytes, bytes], bytes], name: str) -> DataFrame:
    """One state: FAN neighbours (part, part + 1, ...) are merged in a task, level by level. No states give none."""
    states = common.written(states, name)
    while (top := states.agg(F.max("part")).first()[0]) is not None and top > 0:  # one number a level

        def run(batches):
            at, own = None, None
            for batch in batches:
                for part, state in zip(batch["part"].to_pylist(), batch["state"].to_pylist()):
                    if part // FAN != at:
                        if at is not None:
                            yield pa.record_batch({"part": pa.array([at], pa.int64()), "state": pa.array([own], pa.binary())})
                        at, own = part // FAN, state
                    else:
                        own = merge(own, state)
            if at is not None:
                yield pa.record_batch({"part": pa.array([at], pa.int64()), "state": pa.array([own], pa.binary())})

        group = F.floor(F.col("part") / FAN)
        n = min(common.partitions(states.sparkSession), top // FAN + 1)
        dealt = states.repartition(n, group).sortWithinPartitions("part")
        up = common.written(dealt.mapInArrow(run, _STATE), name)
        common.dropped(states)
        states = up
    return states


def _stated(fit: DataFrame, of: Callable, name: str, merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """One state over all rows of fit; of(blocks of rows) gives each task's. As large as a matrix of the dimension."""

    def run(batches):
        state = of(batches)
        if state is not None:
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": pa.array([state], pa.binary())})

    got = reduced(fit.mapInArrow(run, _STATE), merge, name).first()
    return bytes(got["state"]) if got else None


def _blocks(batches, size: int):
    for batch in batches:
        x = _read(batch, size)
        for a in range(0, len(x), ROWS):
            yield x[a : a + ROWS]


def totals(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each dimension)."""

    def of(batches):
        n, sums = 0, [0] * size
        for x in _blocks(batches, size):
            low, high = x & 0xFFFFFFFF, x >> 32  # neither's sum passes a long
            n, sums = n + len(x), [s + int(a) + (int(b) << 32) for s, a, b in zip(sums, low.sum(axis=0), high.sum(axis=0))]
        return _whole([n, *sums]) if n else None

    state = _stated(fit, of, "whiten-sums", lambda a, b: _whole([x + y for x, y in zip(_numbers(a), _numbers(b))]))
    n, *sums = _numbers(state) if state else [0] * (size + 1)
    return n, sums


def _whole(numbers: list[int]) -> bytes:
    return ",".join(map(str, numbers)).encode()


def _numbers(state: bytes) -> list[int]:
    return [int(x) for x in state.split(b",")]


class Centre:
    """x - S / n, exact before it turns into a double."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.float64) / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest


def triangle(fit: DataFrame, size: int, centre: Centre) -> np.ndarray | None:
    """R of the QR of all centred rows, by blocks and then in a tree."""

    def of(batches):
        r = None
        for x in _blocks(batches, size):
            r = np.linalg.qr(centre(x) if r is None else np.vstack([r, centre(x)]), mode="r")
        return None if r is None else r.tobytes()

    def matrix(state: bytes) -> np.ndarray:
        return np.frombuffer(state).reshape(-1, size)

    state = _stated(fit, of, "whiten-r", lambda a, b: np.linalg.qr(np.vstack([matrix(a), matrix(b)]), mode="r").tobytes())
    return matrix(state) if state else None


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of r, by turning pairs of columns until all are orthogonal.

    A sweep meets every pair once in rounds of disjoint pairs, as in a round
    robin, so a round is one numpy step.
    """
    d = r.shape[1]
    u, v = np.array(r, np.float64), np.eye(d)
    scale = np.abs(u).max(initial=0.0)
    u /= scale or 1.0
    seats = list(range(d + d % 2))  # the odd seat stays free
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], reversed(seats[half:])) if max(a, b) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            off = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if not off.any():
                continue
            turned = True
            i, j, aa, bb, ab = i[off], j[off], aa[off], bb[off], ab[off]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (u, v):
                x, y = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    length = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-length, kind="stable")
    return length[order] * scale, v[:, order]


class Model:
    """What tasks need to whiten a row: as large as 16 vectors."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, components: int):
        self.n, self.sums, self.centre, self.size = n, sums, Centre(n, sums), len(sums)
        values, vectors = jacobi(r)
        rank = int((values > max(r.shape) * np.finfo(float).eps * values[:1].sum()).sum())
        k = min(components, rank)
        vectors = vectors[:, :k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        self.values = values[:k] ** 2 / n  # of the covariance
        self.explained = values[:k] ** 2 / (values**2).sum() if k else values[:0]
        self.vectors = vectors / np.linalg.norm(vectors, axis=0)
        self.spread = values[:k] / math.sqrt(n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.vectors / self.spread

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null where it passes a long."""
        base, n = self.centre.base, self.n
        rest = [s % n for s in self.sums]
        near = x - base  # n x - S = n (x - base) - rest
        most = int(np.abs(near).max(initial=0)) * n + n
        if most * most * self.size < 2**63:
            return ((near * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest)) for row in near.tolist()]
        return [v if v < 2**63 else None for v in exact]


def _identity_error(fit: DataFrame, model: Model) -> float | None:
    """Largest entry by size of the whitened fit list's covariance minus the identity; centred before multiplying."""
    size, k = model.size, len(model.values)

    def opened(state: bytes):
        flat = np.frombuffer(state)
        return flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def merge(a: bytes, b: bytes) -> bytes:
        (n, mean, square), (m, other, more) = opened(a), opened(b)
        gap = other - mean
        return np.concatenate([[n + m], mean + gap * (m / (n + m)), (square + more + np.outer(gap, gap) * (n * m / (n + m))).ravel()]).tobytes()

    def of(batches):
        state = None
        for x in _blocks(batches, size):
            w = model.whitened(x)
            mean = w.mean(axis=0)
            own = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes()
            state = own if state is None else merge(state, own)
        return state

    state = _stated(fit, of, "whiten-check", merge)
    if state is None or not k:
        return None
    n, _, square = opened(state)
    return float(np.abs(square / n - np.eye(k)).max())


def whiten(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    common.small_batches(spark)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    lengths = rows.where("v is not null").where(sound).groupBy(F.size("v").alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()  # one row
    size = most["size"] if most else 0
    if not size:
        return spark.createDataFrame([], schema)

    def listed(batches):
        for batch in batches:
            x = _vectors(batch["v"], size)[1]
            yield pa.record_batch({"x": pa.array([row.tobytes() for row in x], pa.binary())})

    fit = common.written(rows.select("v").mapInArrow(listed, "x binary").distinct(), "whiten-fit")
    n, sums = totals(fit, size)
    model = Model(n, sums, triangle(fit, size, Centre(n, sums)), components)
    error, k = _identity_error(fit, model), len(model.values)
    common.dropped(fit)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                b = batch.slice(a, ROWS)
                at, x = _vectors(b["v"], size)
                own = np.repeat(np.arange(len(at)), k)
                yield pa.record_batch(
                    {
                        "vec_id": b["vec_id"].take(pa.array(at[own])),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        "n": pa.array(np.full(len(own), n, np.int64)),
                        "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(own)),
                        "whitened": pa.array(model.whitened(x).ravel()),
                        "explained": pa.array(np.tile(model.explained, len(at))),
                        "identity_error": pa.array(np.full(len(own), np.nan if error is None else error)),
                    }
                )

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
