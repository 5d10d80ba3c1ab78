"""Queries: projections, JSON metadata, explodes, URLs, pairs and benchmarks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.plans.curate import t
from pairmill.plans.registry import query
from pairmill.sources.writers import dense_ids


@query("p02_rename_many", "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS division FROM customer")
def rename(spark, sf):
    return t(spark, sf, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "title", "c_mktsegment": "division"}).drop("c_nationkey", "c_acctbal")


@query("p04_constants", "SELECT doc_id, 'title' AS type, false AS synthesized, 'docs' AS source FROM documents")
def constants(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.lit("title").alias("type"), F.lit(False).alias("synthesized"), F.lit("docs").alias("source"))


@query("p05_field_pairs", "SELECT p_name AS anchor, p_type AS positive FROM part WHERE p_name <> '' AND p_type <> ''")
def field_pairs(spark, sf):
    return t(spark, sf, "part").select(F.col("p_name").alias("anchor"), F.col("p_type").alias("positive")).where(tx.filled(F.col("anchor"), F.col("positive")))


@query("p06_positional", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, string_split(p_name, ' ')[2] AS second FROM part")
def positional(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.get(F.split("p_type", " "), F.lit(0)).alias("first"), F.get(F.split("p_name", " "), F.lit(1)).alias("second"))


@query(
    "p07_two_of_set",
    "SELECT conv_id, s[1] AS anchor, s[least(2, len(s))] AS positive FROM (SELECT conv_id, list(text ORDER BY md5(turn::VARCHAR || '#42'), turn) AS s FROM conversations GROUP BY 1)",
)
def two_of_set(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", F.struct(F.md5(F.concat(F.col("turn").cast("string"), F.lit("#42"))).alias("h"), "turn", "text").alias("x"))
    w = Window.partitionBy("conv_id").orderBy("x.h", "x.turn")
    two = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return two.groupBy("conv_id").agg(F.max(F.when(F.col("rn") == 1, F.col("x.text"))).alias("anchor"), F.max_by("x.text", "rn").alias("positive"))


@query(
    "p10_context_lines",
    "SELECT c_custkey, concat_ws(chr(10), CASE WHEN c_name <> '' THEN 'Name: ' || c_name END, CASE WHEN c_mktsegment <> '' THEN 'Segment: ' || c_mktsegment END) AS context FROM customer",
)
def context_lines(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", tx.labelled_lines({"Name": F.col("c_name"), "Segment": F.col("c_mktsegment")}).alias("context"))


@query("p11_template", "SELECT p_partkey, 'Name: ' || coalesce(p_name, '') || ' Brand: ' || coalesce(p_brand, '') AS text FROM part")
def template(spark, sf):
    return t(spark, sf, "part").fillna("", ["p_name", "p_brand"]).select("p_partkey", F.concat(F.lit("Name: "), "p_name", F.lit(" Brand: "), "p_brand").alias("text"))


@query("p12_metadata_json", "SELECT p_partkey, to_json(struct_pack(brand := p_brand, size := p_size))::VARCHAR AS metadata FROM part")
def metadata(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("metadata"))


@query("p13_merge_json", "SELECT p_partkey, to_json(struct_pack(a := p_brand, b := p_size::VARCHAR, c := 'x'))::VARCHAR AS metadata FROM part")
def merge_json(spark, sf):
    old = F.to_json(F.struct(F.col("p_brand").alias("a"), F.lit("old").alias("c")))
    return t(spark, sf, "part").select("p_partkey", tx.merged_json(old, {"b": F.col("p_size"), "c": F.lit("x")}).alias("metadata"))


@query("p15_key_whitelist", "SELECT p_partkey, to_json(struct_pack(brand := p_brand))::VARCHAR AS corpus, to_json(struct_pack(size := p_size::VARCHAR))::VARCHAR AS query FROM part")
def whitelist(spark, sf):
    meta = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size")))
    return t(spark, sf, "part").select("p_partkey", tx.only_keys(meta, ["brand", "url"]).alias("corpus"), tx.only_keys(meta, ["brand"], keep=False).alias("query"))


@query("p19_dense_ids", "SELECT doc_id, 'c' || (row_number() OVER (ORDER BY doc_id) - 1) AS _id FROM documents")
def dense(spark, sf):
    return dense_ids(t(spark, sf, "documents").select("doc_id"), "doc_id", "c")


@query("p20_join_or_null", "SELECT l_orderkey, nullif(trim(string_agg(CASE WHEN l_returnflag = 'R' THEN l_linenumber::VARCHAR END, ' ' ORDER BY l_linenumber)), '') AS lines FROM lineitem GROUP BY 1")
def join_or_null(spark, sf):
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))), lambda x: x.cast("string"))
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.nullif(F.trim(F.array_join(own, " ")), F.lit("")).alias("lines"))


@query("p21_derived", "SELECT doc_id, length(text) - n_chars AS extra, round(n_chars / 4.0 * 0.15 / 1000, 6)::DOUBLE AS cost FROM documents")
def derived(spark, sf):
    return t(spark, sf, "documents").select("doc_id", (F.length("text") - F.col("n_chars")).alias("extra"), (F.floor(F.col("n_chars") / 4.0 * 0.15 / 1000 * 1e6 + 0.5) / 1e6).alias("cost"))  # rounded in binary, as SQL engines do


@query("p22_aligned_union", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def aligned(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang").unionByName(t(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query(
    "p24_zip_explode",
    "WITH g AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS q, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1) "
    "SELECT conv_id, q[i] AS question, a[i] AS context FROM (SELECT conv_id, q, a, unnest(range(1, greatest(1, coalesce(len(q), 0), coalesce(len(a), 0)) + 1)) AS i FROM g)",
)
def zip_explode(spark, sf):
    own = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    g = t(spark, sf, "conversations").groupBy("conv_id").agg(own("user").alias("question"), own("assistant").alias("context"))
    return g.select("conv_id", F.inline_outer(F.arrays_zip("question", "context")))


@query("p25_explode_outer", "SELECT page_id, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS part FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '/'), lambda x: x <> '') AS p FROM pages)")
def explode_outer(spark, sf):
    parts = F.filter(F.split(tx.url_remainder(F.col("url")), "/"), lambda x: x != "")
    return t(spark, sf, "pages").select("page_id", F.explode_outer(parts).alias("part"))


@query("p26_list_in_string", "SELECT p_partkey, [p_brand, p_type] AS items FROM part")
def list_in_string(spark, sf):
    raw = F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))
    return t(spark, sf, "part").select("p_partkey", tx.pretend_list(raw).alias("items"))


@query("c03_without_extension", r"SELECT page_id, CASE WHEN contains(url, '.') THEN regexp_replace(url, '\.[^.]*$', '') ELSE '' END AS stem FROM pages")
def stem(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.without_extension(F.col("url")).alias("stem"))


@query("c05_title_text", "SELECT p_partkey, trim(concat_ws(' ', coalesce(p_name, ''), coalesce(p_type, ''))) AS text FROM part")
def title_text(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.trim(F.concat_ws(" ", F.coalesce("p_name", F.lit("")), F.coalesce("p_type", F.lit("")))).alias("text"))


@query("c06_question_pairs", "SELECT p_partkey, p_name AS question, p_type AS context FROM part UNION ALL SELECT p_partkey, p_brand, p_name FROM part")
def question_pairs(spark, sf):
    text = F.concat(F.lit("Question: "), "p_name", F.lit("\nContext: "), "p_type", F.lit("\n\nQuestion: "), "p_brand", F.lit("\nContext: "), "p_name")
    rows = t(spark, sf, "part").select("p_partkey", F.inline(tx.question_pairs(text)))
    return rows.toDF("p_partkey", "question", "context")


@query("c08_url_remainder", "SELECT page_id, regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', '') AS rest FROM pages")
def remainder(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.url_remainder(F.col("url")).alias("rest"))


@query(
    "c09_canonical_url",
    r"SELECT page_id, 'https://' || regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') "
    r"|| CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url FROM (SELECT page_id, url, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+'))) AS ps FROM (SELECT page_id, CASE WHEN regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(url) ELSE 'https://' || trim(url) END AS url FROM pages))",
)
def canonical(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query("c10_json_get", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_get(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


_RATE = "CASE WHEN step < warm THEN step / warm ELSE (steps - step) / (steps - warm) + 0.05 * cos(2 * pi() * 4 * (step - warm) / (steps - warm)) END"


@query("c13_rate_schedule", f"WITH n AS (SELECT lang, (ceil(count(*) / 32.0) * 3)::DOUBLE AS steps FROM documents GROUP BY 1), s AS (SELECT lang, steps, floor(steps / 10) + 1 AS warm, unnest(range(0, steps::BIGINT + 1)) AS step FROM n) SELECT lang, step, round(greatest(0, {_RATE}), 6)::DOUBLE AS rate FROM s")
def schedule(spark, sf, batch: int = 32, epochs: int = 3):
    """Rates of all steps that training on each language's documents takes: a warm-up of a tenth, then down with waves."""
    n = t(spark, sf, "documents").groupBy("lang").agg((F.ceil(F.count("*") / batch) * epochs).alias("steps"))
    rows = n.select("lang", "steps", (F.floor(F.col("steps") / 10) + 1).alias("warm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))).alias("step"))
    return rows.select("lang", "step", F.round(F.greatest(F.lit(0.0), F.expr(_RATE)), 6).alias("rate"))


@query("c15_half_even", "SELECT n_nationkey, round_even(n_nationkey / 2.0, 0)::BIGINT AS half FROM nation")
def half_even(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", F.bround(F.col("n_nationkey") / 2.0, 0).cast("long").alias("half"))


@query("c17_pad_and_mask", "SELECT p_partkey, (ws || [0,0,0,0,0,0])[1:6] AS ids, ([1,1,1,1,1,1,1,1,1,1][1:len(ws)] || [0,0,0,0,0,0])[1:6] AS mask FROM (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: length(w)::INTEGER) AS ws FROM part)")
def pad_and_mask(spark, sf):
    ws = F.transform(F.split("p_name", " "), lambda w: F.length(w))
    zeros = F.array_repeat(F.lit(0), 6)
    return t(spark, sf, "part").select("p_partkey", F.slice(F.concat(ws, zeros), 1, 6).alias("ids"), F.slice(F.concat(F.transform(ws, lambda w: F.lit(1)), zeros), 1, 6).alias("mask"))


#: A character that is no white space, as str.strip has it.
_FILLED = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("c18_blank_to_space_all", f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_FILLED}') THEN text ELSE ' ' END AS text FROM documents")
def blank_all(spark, sf):
    return blank_to_space(t(spark, sf, "documents"))


def blank_to_space(docs):
    """doc_id and the whole text; a null or blank one becomes a space."""
    return docs.select("doc_id", F.when(F.col("text").rlike(_FILLED), F.col("text")).otherwise(" ").alias("text"))


@query("c25_value_rename", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' END AS language FROM documents")
def value_rename(spark, sf):
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return t(spark, sf, "documents").select("doc_id", F.element_at(names, F.col("lang")).alias("language"))


@query(
    "k03_benchmark_build",
    "WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'), p AS (SELECT DISTINCT u.text AS query, a.text AS context FROM u JOIN a USING (conv_id, turn) WHERE u.text <> '' AND a.text <> ''), "
    "q AS (SELECT text, 'q' || (row_number() OVER (ORDER BY text) - 1) AS qid FROM (SELECT DISTINCT query AS text FROM p)), c AS (SELECT text, 'c' || (row_number() OVER (ORDER BY text) - 1) AS cid FROM (SELECT DISTINCT context AS text FROM p)) SELECT qid AS \"query-id\", cid AS \"corpus-id\", 1 AS score FROM p JOIN q ON p.query = q.text JOIN c ON p.context = c.text",
)
def benchmark_build(spark, sf):
    c = t(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    pairs = u.join(a, ["conv_id", "turn"]).where(tx.filled(F.col("query"), F.col("context"))).select("query", "context").distinct()
    q = dense_ids(pairs.select("query").distinct(), "query", "q", "query-id")
    d = dense_ids(pairs.select("context").distinct(), "context", "c", "corpus-id")
    return pairs.join(q, "query").join(d, "context").select("query-id", "corpus-id", F.lit(1).alias("score"))
