"""Queries: vectors, retrieval and its metrics, losses, clustering, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.functions import vectors as vx
from pairmill.operators import blocks, retrieval
from pairmill.plans.curate import t
from pairmill.plans.registry import query

#: Every row whose id 100 divides, against all rows but itself.
_SIDES = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS cid, embedding::DOUBLE[] AS cv, label AS cl FROM embeddings)"
_APART = " WHERE qid <> cid"


def _score(score: str) -> str:
    return {
        "cosine": "list_cosine_similarity(qv, cv)",
        "dot": "list_dot_product(qv, cv)",
        "manhattan": "-list_sum(list_transform(list_zip(qv, cv), lambda z: abs(z[1] - z[2])))",
        "euclidean": "-list_distance(qv, cv)",
    }[score]


def _ranked(score: str, k: int) -> str:
    return f"WITH {_SIDES}, s AS (SELECT qid, cid, ql, cl, round({_score(score)}, 6) AS score FROM q, c{_APART}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid DESC) AS rank FROM s QUALIFY rank <= {k})"


def sides(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    return q, e.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("cv"), F.col("label").alias("cl"))


def _top(score):
    def run(spark, sf):
        q, c = sides(spark, sf)
        return blocks.top_k(q, c, score, 10, apart=True).withColumn("rank", F.col("rank").cast("long"))

    return run


for _id, _name in (("v01", "cosine"), ("v02", "dot"), ("v03a", "manhattan"), ("v03b", "euclidean")):
    query(f"{_id}_{_name}_topk_all", f"{_ranked(_name, 10)} SELECT qid AS query_id, cid AS corpus_id, score, rank FROM r")(_top(_name))


@query(
    "r07_retrieval_metrics_all",
    f"""{_ranked("cosine", 10)}, n AS (SELECT qid, count(*) AS n FROM q JOIN c ON cl = ql AND cid <> qid GROUP BY 1), h AS (SELECT qid, rank, sum(1) OVER (PARTITION BY qid ORDER BY rank) AS h FROM r WHERE ql = cl),
    b AS (SELECT qid, n AS r, k FROM n, (SELECT unnest([1, 3, 5, 10]) AS k)),
    m AS (SELECT b.qid, b.k, b.r, count(h.rank) AS hits, coalesce(1.0 / min(h.rank), 0) AS mrr, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg, coalesce(sum(h.h / h.rank), 0) AS ap FROM b LEFT JOIN h ON h.qid = b.qid AND h.rank <= b.k GROUP BY 1, 2, 3)
    SELECT k, round(avg((hits > 0)::INT), 6) AS accuracy, round(avg(hits / k), 6) AS precision, round(avg(hits / r), 6) AS recall, round(avg(mrr), 6)::DOUBLE AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(k, r) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(ap / least(k, r)), 6) AS map, count(*)::BIGINT AS n_queries FROM m GROUP BY k""",
)
def retrieval_metrics_all(spark, sf):
    """Rows of a query's label are relevant: k rows are joined with labels, and counts of labels say how many there are."""
    q, c = sides(spark, sf)
    top = blocks.top_k(q, c, "cosine", 10, apart=True)
    labels = c.select("corpus_id", "cl").where("cl IS NOT NULL")
    hits = top.join(labels, "corpus_id").join(q.select("query_id", F.col("ql").alias("cl")), ["query_id", "cl"]).select("query_id", "rank")
    r = labels.groupBy(F.col("cl").alias("ql")).agg((F.count("*") - 1).alias("r"))
    return retrieval.measured(hits, q.join(r, "ql").where("r > 0").select("query_id", "r"), [1, 3, 5, 10])


@query(
    "v04_hamming_topk_all",
    f"WITH {_SIDES}, s AS (SELECT qid, cid, list_sum(list_transform(list_zip(qv, cv), lambda z: ((z[1] >= 0) = (z[2] >= 0))::INT))::DOUBLE AS score FROM q, c{_APART}) SELECT qid AS query_id, cid AS corpus_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid DESC) AS rank FROM s QUALIFY rank <= 10",
)
def hamming_topk_all(spark, sf):
    return _top("hamming")(spark, sf)


@query("v06_signs", "SELECT vec_id, list_transform(embedding, lambda x: sign(x)::INTEGER) AS signs FROM embeddings")
def signs(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", vx.signs(F.col("embedding")).alias("signs"))


@query(
    "v07_packed_bytes",
    "SELECT vec_id, list_transform(range(0, 8), lambda i: (CASE WHEN b[i+1] > 127 THEN b[i+1] - 256 ELSE b[i+1] END)::INTEGER) AS bytes FROM (SELECT vec_id, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(0, 8), lambda j: CASE WHEN embedding[i*8+j+1] >= 0 THEN (128 >> j) ELSE 0 END))) AS b FROM embeddings)",
)
def packed(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", vx.packed_bytes(F.col("embedding")).alias("bytes"))


@query("v09_unpacked", "SELECT vec_id, list_transform(embedding, lambda x: (x >= 0)::INTEGER) AS bits FROM embeddings")
def unpacked(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", vx.unpacked(vx.packed_bytes(F.col("embedding"))).alias("bits"))


@query("v05_agreement", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (sign(z[1]) * sign(z[2]) + 1) / 2)) / 64, 6)::DOUBLE AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def agreement(spark, sf):
    a = t(spark, sf, "embeddings").select("vec_id", vx.signs(F.col("embedding")).alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(vx.agreement(F.col("x"), F.col("y")), 6).alias("score"))


@query("v11_truncated_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def truncated(spark, sf):
    head = F.slice("embedding", 1, 16)
    return t(spark, sf, "embeddings").select("vec_id", F.round(vx.norm(head), 6).alias("norm"), F.round(vx.truncated(F.col("embedding"), 16)[0], 6).alias("first"))


@query("v12_confidence", "SELECT vec_id, round(1 / list_sum(list_transform(embedding[1:8], lambda x: exp(x::DOUBLE - list_max(embedding[1:8])::DOUBLE))), 6) AS confidence FROM embeddings")
def confidence(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.round(vx.confidence(F.slice("embedding", 1, 8)), 6).alias("confidence"))


@query(
    "r09_triplet_accuracy",
    "WITH x AS (SELECT a.embedding::DOUBLE[] AS a, p.embedding::DOUBLE[] AS p, n.embedding::DOUBLE[] AS n FROM embeddings a JOIN embeddings p ON p.vec_id = a.vec_id + 1 JOIN embeddings n ON n.vec_id = a.vec_id + 2) "
    "SELECT round(avg((list_cosine_similarity(a, p) > list_cosine_similarity(a, n))::INT), 6) AS cosine, round(avg((list_dot_product(a, p) > list_dot_product(a, n))::INT), 6) AS dot, round(avg((list_distance(a, p) < list_distance(a, n))::INT), 6) AS euclidean FROM x",
)
def triplets(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    at = lambda k, c: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(c))
    x = at(0, "a").join(at(1, "p"), "vec_id").join(at(2, "n"), "vec_id")
    won = lambda s: F.round(F.avg((vx.SCORES[s](F.col("a"), F.col("p")) > vx.SCORES[s](F.col("a"), F.col("n"))).cast("int")), 6).alias(s)
    return x.agg(won("cosine"), won("dot"), won("euclidean"))


@query(
    "r10_ranking_loss",
    "WITH p AS (SELECT a.vec_id // 16 AS batch_id, a.vec_id AS i, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT l.batch_id, l.i, r.i AS j, 20 * list_cosine_similarity(l.x, r.y) AS s FROM p l JOIN p r USING (batch_id)), "
    "w AS (SELECT batch_id, i, ln(sum(exp(s))) - max(s) FILTER (i = j) AS loss FROM s GROUP BY 1, 2) SELECT batch_id, count(*)::BIGINT AS rows, round(avg(loss), 6) AS loss FROM w GROUP BY 1",
)
def loss(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("positive"))
    pairs = e.join(b, "vec_id").select(F.floor(F.col("vec_id") / 16).alias("batch_id"), F.col("vec_id").alias("i"), F.col("embedding").alias("anchor"), "positive")
    return retrieval.ranking_loss(pairs)


@query(
    "r19_bm25_all",
    r"""WITH d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM d GROUP BY 1, 2),
    dl AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(size) AS mean FROM dl), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM benchmark),
    s AS (SELECT item_id AS query_id, doc_id AS corpus_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN q USING (word) JOIN df USING (word) JOIN dl USING (doc_id), st GROUP BY 1, 2)
    SELECT query_id, corpus_id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, corpus_id DESC) <= 5""",
)
def bm25_all(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("corpus_id"), "text")
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_top(docs, asked, 5).drop("rank")


@query("v13_kmeans")
def kmeans(spark, sf):
    from pairmill.operators.clustering import clusters

    return clusters(t(spark, sf, "embeddings"), "vec_id", "embedding", 10)


@query("v14_elbow")
def elbow(spark, sf):
    from pairmill.operators.clustering import inertia

    return inertia(t(spark, sf, "embeddings"), "embedding", list(range(4, 22)))


@query("v15_pca")
def pca(spark, sf):
    from pairmill.operators.clustering import components

    return components(t(spark, sf, "embeddings"), "vec_id", "embedding", 2)


@query("x12_token_provider", r"SELECT page_id, len(regexp_extract_all(url, '\w+|[^\w\s]'))::BIGINT AS tokens, 'ok' AS status FROM pages")
def provider(spark, sf):
    from pairmill.operators.providers import WordCounter, enrich

    return enrich(t(spark, sf, "pages"), "page_id", "url", WordCounter())


@query("i07_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows(spark, sf):
    from pairmill.streaming.incremental import event_windows

    rows = event_windows(t(spark, sf, "events"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "i07_sessions",
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
)
def sessions(spark, sf):
    from pairmill.streaming import incremental

    rows = incremental.sessions(t(spark, sf, "events"))
    return rows.select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")
