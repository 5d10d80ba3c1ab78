"""Queries: filters, deduplication, aggregates, sorts, set operations over the raw tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.operators import sampling
from pairmill.operators.retrieval import sent
from pairmill.plans.registry import query


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("s01_column_scan", "SELECT doc_id, lang, source FROM documents")
def column_scan(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang", "source")


@query("s15_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


@query("f02_words_over_half_median", "WITH w AS (SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n FROM documents) SELECT doc_id, n FROM w WHERE n > floor((SELECT quantile_cont(n, 0.5) FROM w) / 2)")
def half_median(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", tx.blank_words(F.col("text")).alias("n"))
    cut = rows.agg(F.floor(F.percentile("n", 0.5) / 2).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).where("n > cut").select("doc_id", "n")  # one row


@query(
    "f03_space_words_over_half_median",
    r"WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents) SELECT doc_id, n FROM w WHERE n > greatest(1, floor(floor((SELECT quantile_cont(n, 0.5) FROM w)) / 2))",
)
def half_median_space(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", tx.space_words(F.col("text")).alias("n"))
    cut = rows.agg(F.greatest(F.lit(1), F.floor(F.floor(F.percentile("n", 0.5)) / 2)).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).where("n > cut").select("doc_id", "n")


@query("f04_words_over_fixed_median", "SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) > 183")
def fixed_median(spark, sf):
    return t(spark, sf, "documents").where(tx.blank_words(F.col("text")) > 183).select("doc_id")


#: Words that mark pages of pictures and addresses.
STOP_WORDS = ("photo", "gallery", "photos", "contact", "figure", "figures")


@query("f05_url_stop_words", f"SELECT page_id, url FROM pages WHERE NOT coalesce(regexp_matches(lower(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', '')), '{'|'.join(STOP_WORDS)}'), false)")
def url_stop_words(spark, sf):
    hit = tx.url_remainder(F.col("url")).rlike("(?i)" + "|".join(STOP_WORDS))
    return t(spark, sf, "pages").select("page_id", "url").where(~F.coalesce(hit, F.lit(False)))


@query("f06_category_filters", "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src1' AND lang = 'en'")
def category(spark, sf):
    return t(spark, sf, "documents").where(~F.col("source").eqNullSafe("src1") & (F.col("lang") == "en")).select("doc_id", "source")


@query("f07_contains", "SELECT doc_id FROM documents WHERE coalesce(contains(text, 'License'), false)")
def contains(spark, sf):
    return t(spark, sf, "documents").where(F.coalesce(F.col("text").contains("License"), F.lit(False))).select("doc_id")


@query("f08_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://www')")
def prefix(spark, sf):
    return t(spark, sf, "pages").where(F.col("url").startswith("https://www")).select("page_id")


@query("f09_quality_gate", "SELECT d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def quality_gate(spark, sf):
    good = t(spark, sf, "labels").where("quality = 1").select("doc_id")
    return t(spark, sf, "documents").select("doc_id", "lang").join(good, "doc_id")


@query("f10_null_gate", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def null_gate(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left").dropna(subset=["quality"]).select("doc_id")


@query("f12_open_range", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 512 AND n_chars < 1024")
def open_range(spark, sf):
    return t(spark, sf, "documents").where("n_chars > 512 and n_chars < 1024").select("doc_id", "n_chars")


@query("f13_isin", "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def isin(spark, sf):
    return t(spark, sf, "events").where(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f17_threshold_to_empty_all", "SELECT doc_id, CASE WHEN length(text) > 5800 THEN '' ELSE text END AS text FROM documents")
def threshold_all(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 5800, "").otherwise(F.col("text")).alias("text"))


@query("f19_negated_contains", "SELECT doc_id FROM documents WHERE NOT coalesce(contains(text, 'the'), false)")
def negated(spark, sf):
    return t(spark, sf, "documents").where(~F.coalesce(F.col("text").contains("the"), F.lit(False))).select("doc_id")


@query(
    "f20_any_column",
    "SELECT * FROM (SELECT unnest(['c_name', 'c_mktsegment']) AS \"column\", unnest([count(*) FILTER (contains(c_name, 'AUTO')), count(*) FILTER (contains(c_mktsegment, 'AUTO'))])::BIGINT AS n FROM customer) WHERE n > 0",
)
def any_column(spark, sf):
    from pairmill.sources.readers import any_column_contains

    return any_column_contains(t(spark, sf, "customer").select("c_name", "c_mktsegment"), "AUTO")


@query("a01_group_to_set", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY 1")
def to_set(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query("a02_shared_relevance", "SELECT a.doc_id, count(*)::BIGINT AS same FROM (SELECT doc_id, md5(text) AS h FROM documents) a JOIN (SELECT md5(text) AS h FROM documents) b USING (h) GROUP BY 1")
def shared(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("same")), "h").select("doc_id", "same")


@query("a03_group_mean", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY 1")
def group_mean(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_qty"))


@query("a05_value_counts", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2 ORDER BY 1, 2")
def value_counts(spark, sf):
    return t(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy("lang", "source")


@query(
    "a06_compared_shares",
    "WITH a AS (SELECT source, 100.0 * count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY 1), b AS (SELECT source, 100.0 * count(*) / sum(count(*)) OVER () AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1) "
    "SELECT coalesce(a.source, b.source) AS source, round(coalesce(a.p, 0), 6)::DOUBLE AS \"all\", round(coalesce(b.p, 0), 6)::DOUBLE AS labelled FROM a FULL JOIN b ON a.source = b.source",
)
def shares(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source")
    some = docs.join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    both = docs.withColumn("of", F.lit("all")).unionByName(some.withColumn("of", F.lit("labelled")))
    n = both.groupBy("source").pivot("of", ["all", "labelled"]).count().fillna(0)
    total = n.agg(F.sum("all").alias("a"), F.sum("labelled").alias("l"))
    share = lambda c, of: F.round(100.0 * F.col(c) / F.col(of), 6).alias(c)
    return n.crossJoin(F.broadcast(total)).select("source", share("all", "a"), share("labelled", "l"))


@query("a07_prefix_counts", "SELECT array_to_string(string_split(url, '/')[3:4], '/') AS head, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def prefix_counts(spark, sf):
    return t(spark, sf, "pages").groupBy(F.array_join(F.slice(F.split("url", "/"), 3, 2), "/").alias("head")).agg(F.count("*").alias("n"))


@query("a08_distinct_count", "SELECT count(DISTINCT text)::BIGINT AS texts, count(DISTINCT source)::BIGINT AS sources FROM documents")
def distinct_count(spark, sf):
    return t(spark, sf, "documents").agg(F.count_distinct(F.sha2("text", 256)).alias("texts"), F.count_distinct("source").alias("sources"))


@query("a09_keep_first", "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def keep_first(spark, sf):
    return t(spark, sf, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")


@query("a10_distinct_rows", "SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, sf):
    return t(spark, sf, "documents").select("lang", "source").distinct()


@query("a11_keep_last", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def keep_last(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("a13_median", "SELECT lang, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY 1")
def median(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.percentile("n_chars", 0.5).alias("median"))


@query("a14_percentiles", "SELECT unnest([0.25, 0.5, 0.75, 0.88, 0.9, 0.99]::DOUBLE[]) AS q, round(unnest(quantile_cont(n_chars, [0.25, 0.5, 0.75, 0.88, 0.9, 0.99])), 6) AS n_chars FROM documents")
def percentiles(spark, sf):
    qs = [0.25, 0.5, 0.75, 0.88, 0.9, 0.99]
    one = t(spark, sf, "documents").agg(F.percentile("n_chars", qs).alias("p"))
    return one.select(F.inline(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("p").alias("n_chars")))).withColumn("n_chars", F.round("n_chars", 6))


@query("a15_describe", "SELECT count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, max(value) AS most FROM events")
def describe(spark, sf):
    return t(spark, sf, "events").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("a16_sums", "SELECT sum(n_chars)::BIGINT AS chars, round(sum(n_chars) / 4.0 * 0.00000015, 6)::DOUBLE AS cost FROM documents")
def sums(spark, sf):
    return t(spark, sf, "documents").agg(F.sum("n_chars").alias("chars"), F.round(F.sum("n_chars") / 4.0 * 0.00000015, 6).alias("cost"))


@query("a17_null_counts", "SELECT count(*) FILTER (quality IS NULL)::BIGINT AS quality, count(*) FILTER (lang IS NULL)::BIGINT AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def null_counts(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id", "left")
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("quality", "lang")])


@query("a18_share_over", "SELECT lang, round(avg((n_chars > 512)::INT), 6) AS share FROM documents GROUP BY 1")
def share_over(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg((F.col("n_chars") > 512).cast("int")), 6).alias("share"))


@query("a19_json_keys", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def json_keys(spark, sf):
    return t(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("a20_pivot_mean", "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS \"F\", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS \"O\", round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def pivot_mean(spark, sf):
    rows = t(spark, sf, "lineitem")
    wide = rows.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_quantity"), 6))
    return wide.join(rows.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean")), "l_returnflag")


@query("a21_pivot_plain", "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1")
def pivot_plain(spark, sf):
    long = t(spark, sf, "labels").select("doc_id", F.inline(F.array(F.struct(F.lit("quality").alias("m"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("m"), F.col("toxic").alias("v")))))
    return long.groupBy("doc_id").pivot("m", ["quality", "toxic"]).agg(F.first("v"))


@query("a22_best_by_column", "SELECT c_mktsegment, max_by(c_custkey, struct_pack(a := c_acctbal, b := c_custkey)) AS best FROM customer GROUP BY 1")
def best(spark, sf):
    return t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("best"))


@query(
    "a24_weighted_mean",
    "WITH s AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS v, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT n_regionkey, round(avg(v), 6) AS mean, round(sum(v * w) / sum(w), 6) AS weighted FROM s GROUP BY 1",
)
def weighted(spark, sf):
    rows = t(spark, sf, "customer").join(sent(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    by = rows.groupBy("n_regionkey", "n_nationkey").agg(F.avg("c_acctbal").alias("v"), F.count("*").alias("w"))
    return by.groupBy("n_regionkey").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")), 6).alias("weighted"))


@query(
    "a26_split_report",
    "WITH s AS (SELECT source, CASE WHEN b < 0.05 THEN 'test' WHEN b < 0.1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT source, ('0x' || substr(md5(doc_id::VARCHAR || '#42'), 1, 8))::BIGINT / 4294967296.0 AS b FROM documents)) "
    "SELECT coalesce(source, 'TOTAL') AS source, count(*) FILTER (split = 'train')::BIGINT AS train, count(*) FILTER (split = 'validation')::BIGINT AS validation, count(*) FILTER (split = 'test')::BIGINT AS test, count(*)::BIGINT AS total FROM s GROUP BY ROLLUP (source)",
)
def split_report(spark, sf):
    rows = sampling.split_by_hash(t(spark, sf, "documents").select("doc_id", "source"), "doc_id", 0.05, 0.05)
    of = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")]
    return rows.rollup("source").agg(*of, F.count("*").alias("total")).withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@query("a27_rows_and_queries", "SELECT conv_id % 7 AS part, count(*)::BIGINT AS n_rows, count(DISTINCT conv_id)::BIGINT AS n_queries FROM conversations GROUP BY 1")
def rows_and_queries(spark, sf):
    return t(spark, sf, "conversations").groupBy((F.col("conv_id") % 7).alias("part")).agg(F.count("*").alias("n_rows"), F.count_distinct("conv_id").alias("n_queries"))


@query("t01_top_by_value", "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50")
def top_by_value(spark, sf):
    return t(spark, sf, "events").select("event_id", "value").orderBy(F.col("value").desc_nulls_last(), "event_id").limit(50)


@query("t08_facet_sort", "SELECT lang, list(source ORDER BY n DESC, source) AS sources FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def facets(spark, sf):
    n = t(spark, sf, "documents").groupBy("lang", "source").count()
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "source")))  # sources of a language
    return n.groupBy("lang").agg(F.transform(order, lambda x: x["source"]).alias("sources"))


@query("u01_union_all", "SELECT 'd' AS kind, doc_id AS id, length(text)::BIGINT AS n FROM documents UNION ALL SELECT 'b', item_id, length(text) FROM benchmark UNION ALL SELECT 'p', page_id, length(html) FROM pages")
def union_all(spark, sf):
    part = lambda name, kind, i, c: t(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.length(c).cast("long").alias("n"))
    return part("documents", "d", "doc_id", "text").unionByName(part("benchmark", "b", "item_id", "text")).unionByName(part("pages", "p", "page_id", "html"))


@query("u04_pair_triplet", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'pair' ELSE 'triplet' END AS kind FROM documents LEFT JOIN labels USING (doc_id)")
def pair_triplet(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality").isNull(), "pair").otherwise("triplet").alias("kind"))


@query("u05_except", "SELECT o_custkey AS customer FROM orders WHERE o_orderdate >= DATE '1998-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1994-01-01'")
def except_(spark, sf):
    """Distinct values of the new collection that the old one lacks."""
    rows = t(spark, sf, "orders")
    new, old = (rows.where(w).select(F.col("o_custkey").alias("customer")) for w in ("o_orderdate >= DATE '1998-01-01'", "o_orderdate < DATE '1994-01-01'"))
    return new.subtract(old)


@query("u07_later_wins", "SELECT doc_id, coalesce(l.quality, -1) AS quality FROM documents LEFT JOIN labels l USING (doc_id)")
def later_wins(spark, sf):
    from pairmill.sources.writers import latest

    old = t(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return latest(old, t(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query(
    "u08_interleave",
    "WITH r AS (SELECT role, conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) - 1 AS rn, count(*) OVER (PARTITION BY role) AS n FROM conversations), m AS (SELECT max(n) AS most FROM r) "
    "SELECT role, id, unnest(range(rn, most, n))::BIGINT AS round FROM r, m",
)
def interleave(spark, sf):
    rows = t(spark, sf, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return sampling.interleaved(rows, "role", "id").select("role", "id", F.col("round").cast("long").alias("round"))


@query("j01_left_chain", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_chain(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("o_orderkey", "c_name", "n_name")


@query("j03_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j06_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("j08_text_lookup", "WITH c AS (SELECT text, min(doc_id) AS cid FROM documents GROUP BY 1) SELECT d.doc_id, c.cid FROM documents d JOIN c USING (text)")
def text_lookup(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("doc_id").alias("cid")), "h").select("doc_id", "cid")


@query("j09_last_duplicate_wins", "SELECT lower(trim(url)) AS url, max_by(page_id, page_id) AS page_id FROM pages GROUP BY 1")
def last_wins(spark, sf):
    return t(spark, sf, "pages").groupBy(F.lower(F.trim("url")).alias("url")).agg(F.max_by("page_id", "page_id").alias("page_id"))


@query("j13_batch_self_join", "SELECT a.conv_id, a.turn AS i, b.turn AS j FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'")
def self_join(spark, sf):
    c = t(spark, sf, "conversations")
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("i"))
    return a.join(c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("j")), "conv_id")


@query("w05_offsets", "SELECT source, n, (sum(n) OVER (ORDER BY source) - n)::BIGINT AS before FROM (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1)")
def offsets(spark, sf):
    n = t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", "n", (F.sum("n").over(Window.orderBy("source")) - F.col("n")).alias("before"))  # a row for each source


@query("w06_first_seen_ids", "SELECT source, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY 1)")
def first_seen(spark, sf):
    first = t(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return first.select("source", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("id"))


@query("m01_hash_split", "SELECT doc_id, CASE WHEN b < 0.05 THEN 'test' WHEN b < 0.1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || '#42'), 1, 8))::BIGINT / 4294967296.0 AS b FROM documents)")
def hash_split(spark, sf):
    return sampling.split_by_hash(t(spark, sf, "documents").select("doc_id"), "doc_id", 0.05, 0.05)


@query(
    "m03_stratified",
    "SELECT doc_id, rn <= round_even(n * 0.1, 0) AS held_out FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id) AS rn, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)",
)
def stratified(spark, sf):
    return sampling.stratified(t(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.1).select("doc_id", "held_out")


@query("m04_stratum_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id) AS rn FROM documents) WHERE rn <= 20")
def stratum_cap(spark, sf):
    return sampling.capped(t(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 20)


@query("m06_uniform_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id LIMIT 150")
def uniform(spark, sf):
    return sampling.sampled(t(spark, sf, "documents").select("doc_id"), "doc_id", 150)


@query(
    "m05_quota_sample",
    "WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '#42'), doc_id) AS rn FROM documents), c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS cells FROM d GROUP BY 1), "
    "q AS (SELECT lang, n, i, cells, least(200 // cells, n) AS q FROM c), z AS (SELECT lang, CASE WHEN i = cells THEN least(n, q + 200 - (SELECT sum(q) FROM q)) ELSE q END AS q FROM q) SELECT doc_id, lang FROM d JOIN z USING (lang) WHERE rn <= q",
)
def quota(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "lang")
    counts = docs.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    quotas = spark.createDataFrame(list(zip([r[0] for r in counts], sampling.quota([r[1] for r in counts], 200))), "lang string, quota long")
    return sampling.quota_sampled(docs, "lang", "doc_id", sent(quotas)).select("doc_id", "lang")


@query(
    "m08_weighted_batches",
    "WITH n AS (SELECT lang, ceil(count(*) / 32.0) AS have FROM documents GROUP BY 1) SELECT lang, have::BIGINT AS have, round_even(have * CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 2.0 ELSE 1.0 END, 0)::BIGINT AS takes FROM n",
)
def batches(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "lang")
    weights = docs.select("lang").distinct().withColumn("weight", F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "de", 2.0).otherwise(1.0))
    got = sampling.weighted_batches(docs, "lang", "doc_id", 32, weights)
    have = docs.groupBy("lang").agg(F.ceil(F.count("*") / 32.0).alias("have"))
    return got.groupBy("lang").agg(F.count_distinct("batch_seq").alias("takes")).join(have, "lang").select("lang", "have", "takes")
