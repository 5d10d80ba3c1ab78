"""Whitening against exact whole numbers and a dense eigendecomposition."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from pairmill.llm import whitening

SF = "/root/testdata/sf0.01"


def brute(rows, components=16):
    """{vec_id: [deviation, whitened...]}, explained; a list of rows for each id."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[(n * x[k] - s[k]) / n for k in range(d)] for x in fit])
    e, c = np.linalg.eigh(centred.T @ centred / n)
    e, c = e[::-1][:components], c[:, ::-1][:, :components]
    out = defaultdict(list)
    for i, x in xs:
        w = np.array([(n * x[k] - s[k]) / n for k in range(d)]) @ c / np.sqrt(e)
        out[i].append((sum((n * x[k] - s[k]) ** 2 for k in range(d)), np.abs(w)))
    return n, out, e / np.trace(centred.T @ centred / n)


def check(df, rows, components=16, rel=1e-6):
    n, want, explained = brute(rows, components)
    got = defaultdict(lambda: defaultdict(list))
    for r in df.collect():
        assert r["n"] == n and r["identity_error"] < 1e-10
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        got[r["vec_id"]][r["component"]].append((r["deviation"], abs(r["whitened"])))
    assert set(got) == set(want)
    for i, each in want.items():
        assert sorted(got[i]) == list(range(1, len(explained) + 1))
        for k, own in got[i].items():
            assert sorted(x for x, _ in own) == sorted(x for x, _ in each)
            assert sorted(x for _, x in own) == pytest.approx(sorted(w[k - 1] for _, w in each), rel=rel, abs=1e-7)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = whitening.op12_whitening(spark, SF)
    check(df, rows)
    by = df.toPandas().pivot(index="vec_id", columns="component", values="whitened")
    assert np.abs(np.cov(by.to_numpy().T, bias=True) - np.eye(16)).max() < 0.05  # one sign for all rows; copies aside


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (k + 1) for k in range(5)]) for i in range(300)]
    rows += [(1, rows[1][1])] * 200 + [(None, rows[2][1]), (7, [0.5] * 5)]  # copies, a null id, an id twice
    rows += [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [1.0, float("nan"), 1.0, 1.0, 1.0]), (404, [float("inf")] + [0.0] * 4), (405, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component string").repartition(7)
    check(whitening.whiten(df), [(i, v) for i, v in rows if v is None or len(v) == 5])
    check(whitening.whiten(df, components=2), [(i, v) for i, v in rows if v is None or len(v) == 5], 2)


def test_many_states_are_merged_in_a_tree(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 3), rng.gauss(0, 9)]) for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), [(i, [float(np.float32(c)) for c in v]) for i, v in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_no_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and all(r["explained"] == pytest.approx(1) for r in got)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")).collect() == []


def test_large_numbers(spark):
    """Deviations beyond a long are null; others exact."""
    huge = spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(huge).collect()} == {1: None, 2: None, 3: 0}
    far = spark.createDataFrame([(1, [1e300]), (2, [0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(far).count() == 3


def test_jacobi_keeps_small_values():
    """Columns of very unlike lengths: each singular value to its own last digits."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 7)))[0]
    scale = 10.0 ** -np.arange(0, 14, 2)
    values, vectors = whitening.jacobi(np.linalg.qr(q * scale, mode="r"))
    assert values == pytest.approx(scale, rel=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(7)).max() < 1e-13
    values, vectors = whitening.jacobi(rng.normal(size=(3, 3)) * 0)
    assert not values.any() and np.array_equal(vectors, np.eye(3))
    m = rng.normal(size=(64, 64))
    assert whitening.jacobi(m)[0] == pytest.approx(np.linalg.svd(m)[1], rel=1e-10)
