"""Queries: a registry of benchmarks made from the vectors, evaluated whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.operators import evaluation
from pairmill.operators.evaluation import AGGREGATES, METRICS, Benchmark
from pairmill.operators.retrieval import grows
from pairmill.plans.curate import t
from pairmill.plans.places import folder
from pairmill.plans.registry import query
from pairmill.sources import readers, writers

SUBSETS = 13
SCORES, KS = ("cosine", "manhattan"), [1, 3, 5, 10]

#: Judgements: rows of the query's label whose ids lie near; so many for a query, whatever the table's size.
NEAR, FAR = 200, 500


def benchmarks(spark, sf):
    """Two benchmarks in folders: ``nano`` in 13 subsets, and ``lab`` with two judgement files over one corpus."""
    path = folder(spark, "benchmarks")
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label", F.concat(F.lit("s"), F.pmod("vec_id", F.lit(SUBSETS)).cast("string")).alias("subset"))
    asked = {"nano": e.where(F.pmod(F.floor(F.col("id") / SUBSETS), F.lit(10)) == 0), "lab": e.where("id % 50 = 0")}
    for name, by in (("nano", ["subset"]), ("lab", [])):
        q = asked[name]
        writers.parquet(e.select(F.col("id").alias("corpus_id"), F.col("v").alias("cv"), *by), f"{path}/{name}/corpus", by)
        writers.parquet(q.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), *by), f"{path}/{name}/queries", by)
        # pairs of near ids by equal cells of ids, so no query meets the whole table
        cell = F.floor(F.col("id") / FAR)
        left = q.select(F.col("id").alias("query_id"), "label", *by, F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        right = e.select(F.col("id").alias("corpus_id"), "label", *by, cell.alias("cell"))
        gap = F.abs(F.col("query_id") - F.col("corpus_id"))
        pairs = grows(left).join(grows(right), ["cell", "label", *by]).where((gap > 0) & (gap <= FAR))
        rels = pairs.select("query_id", "corpus_id", F.lit(1).alias("score"), *by, *([F.when(gap <= NEAR, "near").otherwise("far").alias("data_file")] if name == "lab" else []))
        writers.qrels(rels, f"{path}/{name}/qrels", by if name == "nano" else ["data_file"])
    return [Benchmark("nano", f"{path}/nano", tuple(f"s{k}" for k in range(SUBSETS))), Benchmark("lab", f"{path}/lab", data_files=("near", "far"))]


#: The same benchmarks and their metrics in SQL: res (dataset, subset, data_file, score, k, the metrics, n_queries).
_SQL = f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
qs AS (SELECT 'nano' AS dataset, 's' || (id % {SUBSETS}) AS subset, id, v, label FROM e WHERE (id // {SUBSETS}) % 10 = 0 UNION ALL SELECT 'lab', 'none', id, v, label FROM e WHERE id % 50 = 0),
cs AS (SELECT 'nano' AS dataset, 's' || (id % {SUBSETS}) AS subset, id, v, label FROM e UNION ALL SELECT 'lab', 'none', id, v, label FROM e),
rel AS (SELECT q.dataset, q.subset, CASE WHEN q.dataset = 'nano' THEN 'none' WHEN abs(q.id - c.id) <= {NEAR} THEN 'near' ELSE 'far' END AS data_file, q.id AS qid, c.id AS cid FROM qs q JOIN cs c ON q.dataset = c.dataset AND q.subset = c.subset AND q.label = c.label AND q.id <> c.id AND abs(q.id - c.id) <= {FAR}),
p AS (SELECT q.dataset, q.subset, q.id AS qid, c.id AS cid, q.v AS qv, c.v AS cv FROM qs q JOIN cs c ON q.dataset = c.dataset AND q.subset = c.subset AND q.id <> c.id),
s AS (SELECT dataset, subset, qid, cid, 'cosine' AS score, round(list_cosine_similarity(qv, cv), 6) AS likeness FROM p UNION ALL SELECT dataset, subset, qid, cid, 'manhattan', round(-list_sum(list_transform(list_zip(qv, cv), lambda z: abs(z[1] - z[2]))), 6) FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, subset, score, qid ORDER BY likeness DESC, cid DESC) AS rank FROM s QUALIFY rank <= 10),
h AS (SELECT rel.dataset, rel.subset, rel.data_file, score, r.qid, rank, row_number() OVER (PARTITION BY rel.dataset, rel.subset, rel.data_file, score, r.qid ORDER BY rank) AS h FROM r JOIN rel ON r.dataset = rel.dataset AND r.subset = rel.subset AND r.qid = rel.qid AND r.cid = rel.cid),
b AS (SELECT dataset, subset, data_file, qid, count(*) AS r, score, k FROM rel, (SELECT unnest(['cosine', 'manhattan']) AS score), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY ALL),
m AS (SELECT b.dataset, b.subset, b.data_file, b.score, b.k, b.qid, b.r, count(h.rank) AS hits, coalesce(1.0 / min(h.rank), 0) AS mrr, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg, coalesce(sum(h.h / h.rank), 0) AS ap
  FROM b LEFT JOIN h ON h.dataset = b.dataset AND h.subset = b.subset AND h.data_file = b.data_file AND h.score = b.score AND h.qid = b.qid AND h.rank <= b.k GROUP BY ALL),
res AS (SELECT dataset, subset, data_file, score, k, round(avg((hits > 0)::INT), 6) AS accuracy, round(avg(hits / k), 6) AS precision, round(avg(hits / r), 6) AS recall, round(avg(mrr), 6)::DOUBLE AS mrr,
  round(avg(dcg / list_sum(list_transform(range(1, least(k, r) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(ap / least(k, r)), 6) AS map, count(*)::BIGINT AS n_queries FROM m GROUP BY 1, 2, 3, 4, 5)"""
_MEANS = ", ".join(f"round(avg({m}), 6)::DOUBLE AS {m}" for m in METRICS)
_KEYS = f"""{_SQL}, keys AS (SELECT score AS model, dataset, dataset || '__' || subset || '__' || data_file || '__evaluator_' || score || '_' || metric || '@' || k AS key, value
FROM (UNPIVOT res ON {", ".join(METRICS)} INTO NAME metric VALUE value))"""


def results(spark, sf, **how):
    return evaluation.evaluated(spark, benchmarks(spark, sf), SCORES, KS, apart=True, **how)


@query("r12_subsets", f"{_SQL} SELECT * FROM res UNION ALL SELECT dataset, 'all', 'all', score, k, {_MEANS}, sum(n_queries)::BIGINT FROM res GROUP BY dataset, score, k")
def subsets(spark, sf):
    """Six metrics of every subset and judgement file, and the means of each benchmark's."""
    path = folder(spark, "r12")
    results(spark, sf).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.unionByName(evaluation.macro(rows).withColumn("subset", F.lit("all")).withColumn("data_file", F.lit("all")))


@query("r13_benchmark_registry", f"{_SQL} SELECT dataset, subset, data_file, (SELECT count(*) FROM cs WHERE cs.dataset = rel.dataset AND cs.subset = rel.subset)::BIGINT AS n_corpus, (SELECT count(*) FROM qs WHERE qs.dataset = rel.dataset AND qs.subset = rel.subset)::BIGINT AS n_queries, count(*)::BIGINT AS n_judged FROM rel GROUP BY ALL")
def benchmark_registry(spark, sf):
    """What the registry names, with the sizes of what lies there."""
    registry = benchmarks(spark, sf)
    corpus, queries, judged = evaluation.loaded(spark, registry)
    set_ = ["dataset", "subset"]
    rows = evaluation.units(spark, registry).drop("path")
    for part, name, by in ((corpus, "n_corpus", set_), (queries, "n_queries", set_), (judged, "n_judged", evaluation.UNIT)):
        rows = rows.join(part.groupBy(*by).agg(F.count("*").alias(name)), by, "left")
    return rows.fillna(0).where("n_judged > 0")


@query("a25_macro_aggregate", f"{_SQL} SELECT dataset, score, k, {_MEANS}, sum(n_queries)::BIGINT AS n_queries, 'mean' AS how FROM res GROUP BY 1, 2, 3 UNION ALL SELECT dataset, score, k, {', '.join(f'round(quantile_cont({m}, 0.5), 6)::DOUBLE' for m in METRICS)}, sum(n_queries)::BIGINT, 'median' FROM res GROUP BY 1, 2, 3")
def macro_aggregate(spark, sf):
    path = folder(spark, "a25")
    results(spark, sf).write.parquet(path)
    rows = spark.read.parquet(path)
    return evaluation.macro(rows, "mean").withColumn("how", F.lit("mean")).unionByName(evaluation.macro(rows, "median").withColumn("how", F.lit("median")))


@query("x08_any_aggregate", f"{_SQL} SELECT score, k, round(min(ndcg), 6)::DOUBLE AS least, round(quantile_cont(ndcg, 0.5), 6)::DOUBLE AS median FROM res GROUP BY 1, 2")
def any_aggregate(spark, sf):
    return results(spark, sf).groupBy("score", "k").agg(*[F.round(AGGREGATES[how](F.col("ndcg")), 6).alias(how) for how in ("least", "median")])


@query("r14_not_yet_evaluated", f"{_SQL} SELECT *, CASE WHEN dataset = 'nano' AND subset IN ('s0', 's1', 's2', 's3') OR dataset = 'lab' AND data_file = 'near' THEN 1 ELSE 2 END AS run FROM res")
def not_yet_evaluated(spark, sf):
    """A first run knows some subsets and one judgement file; the second finds its results and evaluates the rest alone."""
    nano, lab = benchmarks(spark, sf)
    path = folder(spark, "r14")
    some = [Benchmark("nano", nano.path, nano.subsets[:4]), Benchmark("lab", lab.path, data_files=("near",))]
    schema = "dataset string, subset string, data_file string, score string, k int, " + ", ".join(f"{m} double" for m in METRICS) + ", n_queries long"
    for run, registry in enumerate((some, [nano, lab]), 1):
        done = None if run == 1 else spark.read.schema(schema).parquet(f"{path}/run=1")
        evaluation.evaluated(spark, registry, SCORES, KS, done, apart=True).write.parquet(f"{path}/run={run}")
    return spark.read.schema(f"{schema}, run int").parquet(path)


@query("c22_metric_keys", f"{_KEYS} SELECT key, round(value, 6) AS value, string_split(key, '__')[1] AS parsed_dataset, string_split(key, '__')[2] AS parsed_subset, string_split(key, '__')[3] AS parsed_data_file, string_split(string_split(string_split(key, '__')[-1], '@')[1], '_')[-1] AS metric, string_split(key, '@')[2]::INTEGER AS at_k FROM keys")
def metric_keys(spark, sf):
    """The keys of an evaluation's dump, taken apart."""
    path = folder(spark, "c22")
    evaluation.dumped(results(spark, sf), path)
    return evaluation.parsed(evaluation.undumped(spark, path).select("key", F.round("value", 6).alias("value")))


@query("f18_metric_prefix", f"{_KEYS} SELECT model, key FROM keys WHERE starts_with(key, 'nano__s1__')")
def metric_prefix(spark, sf):
    path = folder(spark, "f18")
    evaluation.dumped(results(spark, sf), path)
    return evaluation.undumped(spark, path).where(F.col("key").startswith("nano__s1__")).select("model", "key")


@query("a23_mean_over_files", f"{_KEYS} SELECT model, string_split(key, '__evaluator_')[2] AS metric, round(avg(value), 6)::DOUBLE AS value, count(*)::BIGINT AS n FROM keys GROUP BY 1, 2")
def mean_over_files(spark, sf):
    """Mean of each metric over the files that the data sets' results lie in."""
    path = folder(spark, "a23")
    evaluation.dumped(results(spark, sf), path)
    rows = evaluation.undumped(spark, path).withColumn("metric", F.get(F.split("key", "__evaluator_"), F.lit(1)))
    return rows.groupBy("model", "metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


@query("r20_key_rebuilt", f"{_KEYS} SELECT model, 'beir__' || dataset || '_' || string_split(key, '__')[2] || '__evaluator_' || string_split(key, '_')[-1] AS key, round(value, 6) AS value FROM keys WHERE dataset = 'nano'")
def key_rebuilt(spark, sf):
    """A file for each data set, keys with the subset in front, becomes one frame by model with keys of the common form."""
    path = folder(spark, "r20")
    rows = evaluation.keyed(results(spark, sf)).where("dataset = 'nano'")
    old = F.concat(F.lit("nano_"), F.get(F.split("key", "__"), F.lit(1)), F.lit("_evaluator_of_"), F.element_at(F.split("key", "_"), -1))
    by = rows.select("model", F.struct(old.alias("key"), "value").alias("x")).groupBy("model").agg(F.map_from_entries(F.collect_list("x")).alias("metrics"))  # a model's metrics
    writers.jsonl(by, path)
    read = readers.jsonl(spark, path, "model string, metrics map<string,double>").select("model", F.explode("metrics").alias("key", "value"))
    parts = F.split("key", "_")
    subset = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), "_")
    return read.select("model", F.concat(F.lit("beir__"), subset, F.lit("__evaluator_"), F.element_at(parts, -1)).alias("key"), F.round("value", 6).alias("value"))


@query("r22_curve", f"{_SQL} SELECT dataset, k, round(avg(ndcg), 6)::DOUBLE AS ndcg, round(avg(recall), 6)::DOUBLE AS recall, (round(avg(recall), 6) >= 0.1) AS over FROM res WHERE score = 'cosine' GROUP BY 1, 2")
def curve(spark, sf):
    """One model's metrics by k, and where they pass a threshold."""
    rows = evaluation.macro(results(spark, sf).where("score = 'cosine'"))
    return rows.select("dataset", "k", "ndcg", "recall", (F.col("recall") >= 0.1).alias("over")).orderBy("dataset", "k")


@query("r17_json_to_long", f"{_KEYS} SELECT model, dataset, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM keys GROUP BY 1, 2")
def json_to_long(spark, sf):
    """Dumped JSON objects of metrics as a long frame."""
    path = folder(spark, "r17")
    evaluation.dumped(results(spark, sf), path)
    rows = evaluation.parsed(evaluation.undumped(spark, path))
    return rows.groupBy("model", F.col("parsed_dataset").alias("dataset")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("r21_first_of_each_source", "WITH f AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 10), n AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, rn) - 1 AS i FROM f) SELECT 'q' || i AS query_id, 'c' || i AS corpus_id, source, doc_id, md5(text) AS text FROM n")
def first_of_each_source(spark, sf):
    """One query for one document: ten rows of each source, numbered through."""
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = t(spark, sf, "documents").select("source", "doc_id", "text").withColumn("rn", first).where("rn <= 10")  # the limit goes before the shuffle
    i = (F.row_number().over(Window.orderBy("source", "rn")) - 1).cast("string")  # ten rows of each source
    return rows.select(F.concat(F.lit("q"), i).alias("query_id"), F.concat(F.lit("c"), i).alias("corpus_id"), "source", "doc_id", F.md5("text").alias("text"))
