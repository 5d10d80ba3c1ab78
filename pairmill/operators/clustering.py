"""Clusters and principal components of vectors.

All fits of a sweep (every k, several starts) go over the rows together: a
round is one pass in which each task assigns its rows to the centres of all
fits by matrix products and gives sums for each centre, whatever the number of
fits. Only centres come to the driver, and go out with the next round: as many
numbers as the fits have centres. Starts are k-means++ on a bounded sample of
rows, drawn by hash; rounds and costs take all rows.

Rows whose vector is null or holds null or non-finite numbers take no part and
get no cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fits with seeds of their own, of which the best counts; rounds of a fit at most.
STARTS, ROUNDS = 10, 20
#: Rows of the sample that starts are drawn from; rows that a task assigns at once.
SAMPLE, STEP = 5_000, 1_000


def _sound(df: DataFrame, v: str, name: str = "v") -> DataFrame:
    rows = df.withColumn(name, F.col(v).cast("array<double>"))
    return rows.where(F.col(name).isNotNull() & (F.size(name) > 0) & F.forall(name, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _spread_out(rng: np.random.Generator, sample: np.ndarray, k: int) -> np.ndarray:
    """k rows by k-means++; the same row again where there are fewer different ones."""
    out = [sample[rng.integers(len(sample))]]
    near = np.full(len(sample), np.inf)
    for _ in range(k - 1):
        near = np.minimum(near, ((sample - out[-1]) ** 2).sum(axis=1))
        total = near.sum()
        out.append(sample[rng.choice(len(sample), p=near / total)] if total > 0 else sample[rng.integers(len(sample))])
    return np.array(out)


class Fits:
    """Centres of several fits side by side."""

    def __init__(self, centres: list[np.ndarray]):
        self.flat = np.concatenate(centres)
        self.cuts = np.cumsum([0, *map(len, centres)])

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each row's centre in every fit, its squared distance)."""
        far = (self.flat**2).sum(axis=1)[None, :] - 2 * (x @ self.flat.T)
        own = (x**2).sum(axis=1)
        at, cost = np.empty((len(x), len(self.cuts) - 1), np.int64), np.empty((len(x), len(self.cuts) - 1))
        for f, (a, z) in enumerate(zip(self.cuts, self.cuts[1:])):
            best = far[:, a:z].argmin(axis=1)
            at[:, f], cost[:, f] = a + best, np.maximum(0.0, far[np.arange(len(x)), a + best] + own)
        return at, cost


def _passed(rows: DataFrame, fits: Fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of each centre, their sum, cost of each fit): one pass, summed up in each task and then by centre."""
    n, cuts = len(fits.flat), len(fits.cuts) - 1

    def run(batches):
        count, total, cost = np.zeros(n), None, np.zeros(cuts)
        for batch in batches:
            x = _matrix(batch["v"])
            for a in range(0, len(x), STEP):
                part = x[a : a + STEP]
                at, far = fits.assigned(part)
                belongs = np.zeros((len(part), n))
                np.put_along_axis(belongs, at, 1.0, axis=1)
                total = belongs.T @ part + (0 if total is None else total)
                count, cost = count + belongs.sum(axis=0), cost + far.sum(axis=0)
        if total is not None:
            some = np.flatnonzero(count)
            sums = [[c, *t] for c, t in zip(count[some], total[some])] + [[c, *[0.0] * total.shape[1]] for c in cost]
            yield pa.record_batch({"centre": pa.array([*some.tolist(), *range(n, n + cuts)], pa.int64()), "sums": pa.array(sums, pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "centre long, sums array<double>").select("centre", array_to_vector("sums").alias("s"))
    got = parts.groupBy("centre").agg(Summarizer.sum(F.col("s")).alias("s")).collect()  # a row for each centre and fit
    count, total, cost = np.zeros(n), np.zeros_like(fits.flat), np.zeros(cuts)
    for r in got:
        s = r["s"].toArray()
        if r["centre"] >= n:
            cost[r["centre"] - n] = s[0]
        else:
            count[r["centre"]], total[r["centre"]] = s[0], s[1:]
    return count, total, cost


def fitted(df: DataFrame, v: str, ks: list[int], seed: int = 42, starts: int = STARTS, rounds: int = ROUNDS) -> dict[int, tuple[float, np.ndarray]]:
    """{k: (cost, centres)} of the best of several fits; a centre without rows stays where it is. No rows: empty."""
    rows = _sound(df, v).select("v")
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()])
    if not len(sample):
        return {}
    plans = [(k, s) for k in ks for s in range(seed, seed + starts)]
    centres = [_spread_out(np.random.default_rng([s, k]), sample, k) for k, s in plans]
    for _ in range(rounds):
        fits = Fits(centres)
        count, total, _ = _passed(rows, fits)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], fits.flat)
        moved = np.abs(new - fits.flat).max() > 1e-9
        centres = [new[a:z] for a, z in zip(fits.cuts, fits.cuts[1:])]
        if not moved:
            break
    _, _, cost = _passed(rows, Fits(centres))
    best: dict[int, tuple[float, np.ndarray]] = {}
    for (k, _), c, own in zip(plans, cost.tolist(), centres):
        if k not in best or c < best[k][0]:
            best[k] = c, own
    return best


def clusters(df: DataFrame, key: str, v: str, k: int, seed: int = 42, starts: int = STARTS) -> DataFrame:
    """key, cluster of every row with a sound vector; the best of several fits."""
    found = fitted(df, v, [k], seed, starts)
    fits = Fits([found[k][1]]) if found else None

    def run(batches):
        for batch in batches:
            x = _matrix(batch["v"])
            at = np.concatenate([np.zeros(0, np.int64), *[fits.assigned(x[a : a + STEP])[0][:, 0] for a in range(0, len(x), STEP)]])
            yield pa.record_batch({key: batch[key], "cluster": pa.array(at.astype(np.int32))})

    rows = _sound(df, v).select(key, "v")
    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, cluster int")


def inertia(df: DataFrame, v: str, ks: list[int], seed: int = 42, starts: int = STARTS) -> DataFrame:
    """k and the least cost of its clusters over several fits, to choose k by the bend."""
    found = fitted(df, v, ks, seed, starts)
    return df.sparkSession.createDataFrame([(k, found[k][0]) for k in sorted(found)], "k int, inertia double")


def components(df: DataFrame, key: str, v: str, n: int) -> DataFrame:
    """key and the first n principal components of centred vectors; signs are arbitrary."""
    rows = _sound(df, v).select(key, array_to_vector("v").alias("features"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="c").fit(rows).transform(rows)
    return PCA(k=n, inputCol="c", outputCol="p").fit(centred).transform(centred).select(key, vector_to_array("p").alias("components"))
