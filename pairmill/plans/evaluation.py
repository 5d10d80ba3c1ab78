"""Queries: evaluation tables, joins of results, clean-ups, sampling states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.plans.curate import t
from pairmill.plans.registry import query


def _judged(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("corpus_id"), F.pmod(F.col("l_quantity").cast("long"), F.lit(4)).alias("score"))


_JUDGED = "(SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS corpus_id, l_quantity::BIGINT % 4 AS score FROM lineitem)"


@query("f11_filled", "SELECT item_id FROM benchmark WHERE trim(text) <> ''")
def filled(spark, sf):
    return t(spark, sf, "benchmark").where(F.trim("text") != "").select("item_id")


@query("f14_relevant", f"SELECT query_id, count(*) AS n FROM {_JUDGED} WHERE score > 0 GROUP BY 1")
def relevant(spark, sf):
    return _judged(spark, sf).where("score > 0").groupBy("query_id").agg(F.count("*").alias("n"))


@query("f15_texts_with_content", "SELECT doc_id AS _id, text FROM documents WHERE length(text) > 0")
def texts_with_content(spark, sf):
    return t(spark, sf, "documents").where(F.char_length("text") > 0).select(F.col("doc_id").alias("_id"), "text")


@query("j02_left_with_suffix", "SELECT c.c_custkey AS key, c.c_name AS name, n.n_name AS name_right FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def left_with_suffix(spark, sf):
    left = t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("at"))
    right = t(spark, sf, "nation").select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("name"))
    both = set(left.columns) & set(right.columns) - {"at"}
    return left.join(right.withColumnsRenamed({c: f"{c}_right" for c in both}), "at", "left").drop("at")


@query("j07_results_to_rows", "SELECT o.o_orderkey, o.o_orderstatus, r.n_lines FROM orders o JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) r ON r.l_orderkey = o.o_orderkey")
def results_to_rows(spark, sf):
    results = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return t(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(results, "o_orderkey")


@query("j10_in_asked_order", "SELECT row_number() OVER (ORDER BY n_name) - 1 AS place, n_nationkey, n_name FROM nation")
def in_asked_order(spark, sf):
    """Rows in the order of a list of ids; an id that isn't there is an error."""
    asked = t(spark, sf, "nation").select("n_nationkey", (F.row_number().over(Window.orderBy("n_name")) - 1).cast("long").alias("place"))  # the list, a few ids
    rows = asked.join(t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left")
    there = F.when(F.col("n_name").isNull(), F.raise_error(F.lit("an id is missing"))).otherwise(F.col("n_name"))
    return rows.select("place", "n_nationkey", there.alias("n_name"))


@query("a12_distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("t02_longest_first", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 50")
def longest_first(spark, sf):
    """The fifty longest: a report."""
    top = t(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")).cast("long"))


@query("t06_best_for_one", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def best_for_one(spark, sf):
    """Ten best rows for one vector; the vector is one row, sent to all tasks."""
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.where("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", F.round(dot, 5).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(10)  # one row


@query("t07_by_index", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey")
def by_index(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")


@query("u02_union_of_splits", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM orders")
def union_of_splits(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey")
    test, train = rows.where("o_orderkey % 10 = 0"), rows.where("o_orderkey % 10 <> 0")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("u06_columns_missing", "SELECT unnest(['n_nationkey', 'n_regionkey']) AS missing")
def columns_missing(spark, sf):
    """Columns that one table has and the other, after its names are mapped, lacks."""
    left, right = t(spark, sf, "nation").columns, [{"r_name": "n_name"}.get(c, c) for c in t(spark, sf, "region").columns]
    return spark.createDataFrame([(c,) for c in left if c not in right], "missing string")


@query("c01_word_counts", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS by_blank, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS by_space FROM documents WHERE text IS NOT NULL")
def word_counts(spark, sf):
    gaps = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("by_blank"), F.size(gaps).cast("long").alias("by_space"))


@query("c02_division", "SELECT page_id, string_split(url, '/')[4] AS division FROM pages")
def division(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(3)).alias("division"))


@query("c04_normalised", "SELECT n_nationkey, replace(lower(trim(n_name)), ' ', '-') AS key, length(n_name) AS size FROM nation")
def normalised(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", F.replace(F.lower(F.trim("n_name")), F.lit(" "), F.lit("-")).alias("key"), F.char_length("n_name").cast("long").alias("size"))


@query("c11_arrays", "SELECT p_partkey, len(list_distinct(string_split(p_name, ' ')))::BIGINT AS n, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS joined FROM part")
def arrays(spark, sf):
    own = F.array_distinct(F.split("p_name", " "))
    return t(spark, sf, "part").select("p_partkey", F.size(own).cast("long").alias("n"), F.array_join(F.array_sort(own), "|").alias("joined"))


@query("c14_training_steps", "SELECT lang, (ceil(count(*) / (16.0 * 2 * 4)) * 3)::BIGINT AS steps FROM documents GROUP BY 1")
def training_steps(spark, sf, batch: int = 16, ranks: int = 2, accumulated: int = 4, epochs: int = 3):
    return t(spark, sf, "documents").groupBy("lang").agg((F.ceil(F.count("*") / F.lit(batch * ranks * accumulated)) * epochs).cast("long").alias("steps"))


@query("p03_dropped", "SELECT c_custkey, c_name FROM customer")
def dropped(spark, sf):
    return t(spark, sf, "customer").drop("c_nationkey", "c_acctbal", "c_mktsegment")


@query("p14_arrays_as_json", "SELECT vec_id, len(embedding)::BIGINT AS n, label FROM embeddings")
def arrays_as_json(spark, sf):
    """Vectors through JSON and back."""
    rows = t(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("dump"), "label")
    return rows.select("vec_id", F.size(F.from_json("dump", "array<double>")).cast("long").alias("n"), "label")


@query("p23_dropped_by_ending", "SELECT s_suppkey, s_nationkey FROM supplier")
def dropped_by_ending(spark, sf):
    rows = t(spark, sf, "supplier")
    return rows.select(*[c for c in rows.columns if not c.endswith(("name", "bal"))])


@query("m13_source_weights", "SELECT source, count(*) AS n, round(41.0::DOUBLE / count(*), 9) AS weight FROM documents GROUP BY 1")
def source_weights(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.lit(41.0) / F.count("*"), 9).alias("weight"))


@query("x03_many_columns", "SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, ' '))::BIGINT AS words, upper(lang) AS tongue FROM documents WHERE text IS NOT NULL")
def many_columns(spark, sf):
    """One function of a row gives a struct, its fields become columns."""
    of = F.struct(F.char_length("text").cast("long").alias("chars"), F.size(F.split("text", " ")).cast("long").alias("words"), F.upper("lang").alias("tongue"))
    return t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", of.alias("r")).select("doc_id", "r.*")
