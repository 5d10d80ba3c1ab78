"""Components of long chains and hubs; near copies that hang together by chains, in hubs and in hot buckets."""

import random

from pairmill.llm import neardup
from pairmill.llm.components import components


def test_long_chain_and_hub(spark):
    ids = list(range(10_000))
    random.Random(3).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    ordered = [(20_000 + i, 20_001 + i) for i in range(3_000)]
    hub = [(50_000, 50_000 + i) for i in range(1, 3_000)] + [(99_999, 99_999)]
    got = components(spark.createDataFrame(chain + ordered + hub, "a long, b long")).groupBy("label").count().collect()
    assert sorted((r["label"], r["count"]) for r in got) == [(0, 10_000), (20_000, 3_001), (50_000, 3_000)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_near_copies(spark):
    """Each document is linked with its neighbours alone."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(6 * i, 6 * i + 60))) for i in range(300)], "doc_id long, text string")
    rows = neardup.near_duplicates(docs, width=4).collect()
    assert {r["component_id"] for r in rows} == {0} and sum(r["kept"] for r in rows) == 1


def test_hub_and_hot_bucket(spark):
    """Many near copies of one text, and many texts that share a passage but are no near copies."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1_500):
        words = list(base)
        words[rng.randrange(100)] = f"n{i}"
        rows.append((i, " ".join(words)))
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(5_000 + i, shared + " " + " ".join(f"o{i}x{k}" for k in range(20))) for i in range(400)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).toPandas()
    by = got.groupby("component_id").size()
    assert by[0] == 1_500 and len(by) == 401 and got.kept.sum() == 401
