"""Evaluation sets: relevance by equal text within a data set, on classes and spelled out."""

import pytest
from pyspark.sql import functions as F

from pairmill.operators import evalsets, retrieval


def test_set_and_metrics(spark):
    rows = [("a", 5, "q5", "same", "n"), ("a", 2, "q2", "same", None), ("a", 9, "q9", "other", "n"), ("b", 1, "q1", "same", None), ("a", 7, None, "x", None), ("a", 8, "q", None, None)]
    df = spark.createDataFrame(rows, "name string, o long, anchor string, positive string, negative string")
    got = evalsets.built(df, "o")
    assert sorted((r["qid"], r["text"]) for r in got.queries.collect()) == [("a_q_0", "q2"), ("a_q_1", "q5"), ("a_q_2", "q9"), ("b_q_0", "q1")]
    pairs = sorted(map(tuple, evalsets.judgements(got).collect()))
    assert pairs == [("a_q_0", "a_c_0"), ("a_q_0", "a_c_1"), ("a_q_1", "a_c_0"), ("a_q_1", "a_c_1"), ("a_q_2", "a_c_2"), ("b_q_0", "b_c_0")]
    assert {r["qid"]: r["r"] for r in evalsets.relevant(got).collect()} == {"a_q_0": 2, "a_q_1": 2, "a_q_2": 1, "b_q_0": 1}
    assert got.triplets.count() == 2 and evalsets.built(df, "o", 1).queries.count() == 2
    with pytest.raises(Exception, match="over 1 rows"):
        evalsets.judgements(got, 1).collect()
    with pytest.raises(ValueError):
        evalsets.built(df.drop("anchor"), "o")


def test_metrics_on_classes_are_those_of_pairs(spark):
    rows = [("s", n, f"q{n}", f"p{n % 7}") for n in range(60)]
    df = spark.createDataFrame(rows, "name string, o long, anchor string, positive string")
    got = evalsets.built(df, "o")
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.xxhash64("text", i), F.lit(1000)) - 500).cast("double"))
    q, c = got.queries.select("name", "id", vector.alias("v")), got.corpus.select("name", "id", vector.alias("v"))
    by_class = {r["k"]: r.asDict() for r in evalsets.ranked_metrics(got, q, c).drop("name").collect()}
    from pairmill.operators import blocks

    top = blocks.top_k(q.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), c.select(F.col("id").alias("corpus_id"), F.col("v").alias("cv")), "cosine", 10)
    pairs = evalsets.judgements(got).select(*[F.element_at(F.split(x, "_"), -1).cast("long").alias(n) for x, n in (("qid", "query_id"), ("cid", "corpus_id"))])
    assert by_class == {r["k"]: r.asDict() for r in retrieval.metrics(top, pairs, evalsets.TRAINING_KS).collect()}
