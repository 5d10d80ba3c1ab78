"""Queries answer all that they are asked: no ids, starts or sweeps are left out."""

import pytest
from oracle import assert_same, connect

from pairmill.plans import catalog, pairing

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["v01_cosine", "v02_dot", "v03a_manhattan", "v03b_euclidean", "v04_hamming"])
def test_every_row_is_searched(spark, name):
    got = catalog.queries()[f"{name}_topk_all"](spark, SF).toPandas()
    ids = set(spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").toPandas().vec_id)
    assert set(got.query_id) == ids and (got.groupby("query_id").size() == 10).all()
    assert (got.query_id != got.corpus_id).all() and (got.corpus_id < 50).any()


def test_metrics_of_every_row(spark):
    assert_same(catalog.queries()["r07_retrieval_metrics_all"](spark, SF), connect(SF), catalog.oracle_sql()["r07_retrieval_metrics_all"])


def test_every_benchmark_item_is_searched(spark):
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert catalog.queries()["r19_bm25_all"](spark, SF).select("query_id").distinct().count() == asked


def test_whole_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for name, want in (("f17_threshold_to_empty_all", lambda x: "" if x and len(x) > 5800 else x), ("c18_blank_to_space_all", lambda x: x if x and x.strip() else " ")):
        assert {r["doc_id"]: r["text"] for r in catalog.queries()[name](spark, SF).collect()} == {i: want(x) for i, x in docs.items()}


def test_only_blank_texts_become_a_space(spark):
    texts = [None, "", " ", "\t\n\x0b\x1c\x85\xa0\u2003\u3000", " a", "\n\nb ", "\u200b", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in pairing.blank_to_space(docs).orderBy("doc_id").collect()] == [x if x and x.strip() else " " for x in texts]


def test_elbow_sweeps_all_k(spark):
    from pairmill.operators import clustering

    got = {r["k"]: r["inertia"] for r in catalog.queries()["v14_elbow"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == list(range(4, 22))
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    each = [clustering.inertia(e, "embedding", [7], seed, 1).first()["inertia"] for seed in range(42, 52)]
    assert got[7] == pytest.approx(min(each))


def test_bm25_without_pairs(spark, monkeypatch):
    """no pair of a query and a document is shuffled; odd texts, repeated ids and the path by word give what SQL gives."""
    import duckdb
    from test_positions import shuffled_bytes

    from pairmill.operators import retrieval

    con = duckdb.connect()
    con.execute("create table documents as select i // 2 + (i % 2) * (i % 7) as doc_id, case when i % 11 = 0 then NULL when i % 13 = 0 then ' ' else ' Le  ' || chr(9) || 'w' || (i % 17) || chr(10) || 'W' || (i % 5) || ' ÉTÉ w' || (i % 3) end as text from range(3000) r(i)")
    con.execute("create table benchmark as select * from (values (1, 'w1  w2 été'), (2, ''), (3, NULL), (4, 'nowhere'), (5, 'LE w16 w16'), (1, 'w4')) v(item_id, text)")
    want = sorted(con.sql(catalog.oracle_sql()["r19_bm25_all"]).fetchall())
    docs, asked = (spark.createDataFrame(con.sql(f"select * from {name}").df().astype(object).where(lambda x: x.notna(), None), schema) for name, schema in (("documents", "corpus_id long, text string"), ("benchmark", "query_id long, text string")))
    before = shuffled_bytes(spark)
    assert sorted(tuple(r) for r in retrieval.bm25_top(docs, asked, 5).select("query_id", "corpus_id", "score").collect()) == want
    assert shuffled_bytes(spark) - before < 150_000
    monkeypatch.setattr(retrieval, "TOGETHER", 2)
    monkeypatch.setattr(retrieval, "CELLS", 5)
    assert sorted(tuple(r) for r in retrieval.bm25_top(docs, asked, 5).select("query_id", "corpus_id", "score").collect()) == want
