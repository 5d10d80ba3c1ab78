"""K-means over many fits at once and principal components, against plain numpy."""

import numpy as np
import pytest

from pairmill.operators import clustering, evaluation
from pairmill.plans import catalog

SF = "/root/testdata/sf0.001"


def lloyd(x, centres, rounds=clustering.ROUNDS):
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_many_fits_are_the_single_ones(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (60, 3)) for c in (0, 6, 12)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0])], "id long, v array<double>").repartition(5)
    got = clustering.fitted(df, "v", [2, 3, 4], seed=7, starts=3)
    sample = np.array([r["v"] for r in clustering._sound(df, "v").selectExpr("v").orderBy(clustering.F.xxhash64("v"), "v").collect()])
    for k in (2, 3, 4):
        want = min(lloyd(x, clustering._spread_out(np.random.default_rng([s, k]), sample, k)) for s in (7, 8, 9))
        assert got[k][0] == pytest.approx(want, rel=1e-9)
    rows = {r["id"]: r["cluster"] for r in clustering.clusters(df, "id", "v", 3, seed=7, starts=3).collect()}
    assert sorted(rows) == list(range(180)) and [len({rows[i] for i in range(a, a + 60)}) for a in (0, 60, 120)] == [1, 1, 1] and len(set(rows.values())) == 3


def test_few_or_no_rows(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, v array<double>")
    assert clustering.inertia(one, "v", [3]).first()["inertia"] == 0 and clustering.clusters(one, "id", "v", 3).count() == 4
    none = one.where("id < 0")
    assert clustering.inertia(none, "v", [3]).collect() == [] == clustering.clusters(none, "id", "v", 3).collect()


def test_components_are_those_of_a_dense_decomposition(spark):
    got = {r["vec_id"]: r["components"] for r in catalog.queries()["v15_pca"](spark, SF).collect()}
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = np.array([rows[i] for i in sorted(rows)], float)
    x = x - x.mean(axis=0)
    v = np.linalg.svd(x, full_matrices=False)[2][:2]
    assert np.abs(np.array([got[i] for i in sorted(rows)])) == pytest.approx(np.abs(x @ v.T), abs=1e-6)


def test_timed_evaluation(spark):
    rows, took, each = evaluation.timed(lambda: spark.range(8), 4)
    assert len(rows) == 8 and took > 0 and each == took / 4
