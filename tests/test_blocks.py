"""Search in blocks against brute force: small blocks, several data sets, ties, odd vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.operators import blocks


def brute(queries, corpus, score, k, apart):
    out = []
    for d, i, q in queries:
        found = []
        for e, j, c in corpus:
            if d != e or not q or not c or len(q) != len(c) or any(x is None or not np.isfinite(x) for x in [*q, *c]) or apart and i == j:
                continue
            x, y = np.array(q, float), np.array(c, float)
            if score == "cosine" and not (x.any() and y.any()):
                continue
            s = {
                "cosine": lambda: x @ y / np.linalg.norm(x) / np.linalg.norm(y),
                "dot": lambda: x @ y,
                "manhattan": lambda: -np.abs(x - y).sum(),
                "euclidean": lambda: -np.sqrt(((x - y) ** 2).sum()),
                "hamming": lambda: float(((x >= 0) == (y >= 0)).sum()),
            }[score]()
            found.append((round(float(s), 6) + 0.0, j))
        found = sorted(found, key=lambda p: (-p[0], -p[1]))[:k]
        out += [(d, i, j, s, n + 1) for n, (s, j) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("score", blocks.SCORES)
@pytest.mark.parametrize("apart", [False, True])
def test_small_blocks(spark, monkeypatch, score, apart):
    rng = random.Random(7)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]  # noqa: E731  many ties
    corpus = [(f"set{n % 3}", n, vec()) for n in range(150)] + [("set1", 900 + n, v) for n, v in enumerate([None, [], [1.0, None, 1.0, 1.0], [float("nan")] * 4, [0.0] * 4, [1.0] * 5])]
    queries = [(d, i, v) for d, i, v in corpus if i % 7 == 0 and v and len(v) == 4] + [("lonely", 1, vec())]
    for name, value in (("QUERY_ROWS", 4), ("CORPUS_ROWS", 11), ("STEP", 3)):
        monkeypatch.setattr(blocks, name, value)
    q = spark.createDataFrame(queries, "data string, query_id long, qv array<double>")
    c = spark.createDataFrame(corpus, "data string, corpus_id long, cv array<double>")
    got = blocks.top_k(q, c, score, 5, by=["data"], apart=apart)
    assert "Cartesian" not in got._jdf.queryExecution().toString()
    assert sorted((tuple(r) for r in got.select("data", "query_id", "corpus_id", "score", "rank").collect()), key=str) == brute(queries, corpus, score, 5, apart)


def test_without_sets_and_empty(spark):
    rows = [(n, [float(n), 1.0]) for n in range(10)]
    c = spark.createDataFrame(rows, "corpus_id long, cv array<float>")
    q = spark.createDataFrame(rows[:2], "query_id long, qv array<float>")
    got = blocks.top_k(q, c, "dot", 3)
    assert sorted(map(tuple, got.select("query_id", "corpus_id", "rank").collect())) == [(0, 7, 3), (0, 8, 2), (0, 9, 1), (1, 7, 3), (1, 8, 2), (1, 9, 1)]
    assert blocks.top_k(q.where(F.lit(False)), c, "dot", 3).collect() == [] == blocks.top_k(q, c.where(F.lit(False)), "dot", 3).collect()
    with pytest.raises(ValueError):
        blocks.top_k(q, c, "other", 3)


def test_products_are_bounded():
    """a full block of queries meets no more scores at once than a small one."""
    assert all(blocks.product_rows(n) * n <= 250_000 for n in (1, 10, 200, 1_000)) and blocks.product_rows(10**7) == 1


def test_results_have_a_short_lineage(spark):
    """the ranking is a table before it is measured, so tasks don't send the counters of the whole search."""
    from pairmill.plans import benchmarks

    plan = benchmarks.results(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
