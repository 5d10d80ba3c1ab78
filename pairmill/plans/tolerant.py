"""Queries: values whose shape differs from row to row, nested values as strings, joins by a row's index."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.functions import variants as vr
from pairmill.plans.curate import t
from pairmill.plans.registry import query


def _articles(spark, sf):
    """event_id and an article in JSON: its citation an object, a list or an empty list, its abstract a list, a string, an object, null or missing."""
    e = t(spark, sf, "events")
    k = F.pmod("event_id", F.lit(6))
    title, kind = F.concat(F.lit('"ArticleTitle": "t'), F.col("event_id").cast("string"), F.lit('"')), F.col("event_type")
    text = (
        F.when(k == 0, F.concat(F.lit('["first '), kind, F.lit('", "second"]')))
        .when(k == 1, F.concat(F.lit('"plain '), kind, F.lit('"')))
        .when(k == 2, F.concat(F.lit('{"text": "inner '), kind, F.lit('"}')))
        .when(k == 5, F.lit("null"))
    )
    article = F.concat(F.lit('{"Article": {'), title, F.coalesce(F.concat(F.lit(', "Abstract": {"AbstractText": '), text, F.lit("}")), F.lit("")), F.lit("}}"))
    citation = F.when(k == 1, F.concat(F.lit("["), article, F.lit("]"))).when(k == 3, F.lit("[]")).otherwise(article)
    return e.select("event_id", F.concat(F.lit('{"MedlineCitation": '), citation, F.lit("}")).alias("json"), "props", "event_type", "value")


@query("p08_nested_or_empty", "SELECT event_id, CASE WHEN event_id % 6 IN (1, 3) THEN '' ELSE 't' || event_id END AS title, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS none FROM events")
def nested_or_empty(spark, sf):
    """Paths that are there in some rows, in all and in none."""
    return _articles(spark, sf).select("event_id", vr.got(F.col("json"), "$.MedlineCitation.Article.ArticleTitle").alias("title"), vr.got(F.col("props"), "$.k").alias("k"), vr.got(F.col("event_type"), "$.k").alias("none"))


@query("p09_tolerant_pairs", "SELECT event_id, 't' || event_id AS anchor, CASE event_id % 6 WHEN 0 THEN 'first ' || event_type || ' second' WHEN 1 THEN 'plain ' || event_type ELSE 'inner ' || event_type END AS positive FROM events WHERE event_id % 6 < 3")
def tolerant_pairs(spark, sf):
    """Title and abstract, whatever shape they come in; rows that lack one go."""
    citation = vr.first_of(F.try_variant_get(F.try_parse_json("json"), "$.MedlineCitation", "variant"))
    rows = _articles(spark, sf).select("event_id", citation.alias("c"))
    at = lambda path: vr.tolerant_text(F.try_variant_get("c", path, "variant"))
    return rows.select("event_id", at("$.Article.ArticleTitle").alias("anchor"), at("$.Article.Abstract.AbstractText").alias("positive")).where("anchor <> '' AND positive <> ''")


@query("p09_joined_abstract", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role) AS abstract FROM conversations WHERE text <> '' GROUP BY 1")
def joined_abstract(spark, sf):
    rows = t(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("parts"))  # a conversation's turns
    return rows.select("conv_id", F.concat_ws(" ", "parts.text").alias("abstract"))


@query("f16_both_strings", "SELECT event_id FROM events WHERE event_id % 6 = 1")
def both_strings(spark, sf):
    """Both values are strings by type: lists, objects, numbers and null are not."""
    v = F.try_parse_json("json")
    first = vr.first_of(F.try_variant_get(v, "$.MedlineCitation", "variant"))
    rows = _articles(spark, sf).select("event_id", first.alias("c"))
    both = vr.is_text(F.try_variant_get("c", "$.Article.ArticleTitle", "variant")) & vr.is_text(F.try_variant_get("c", "$.Article.Abstract.AbstractText", "variant"))
    return rows.where(both).select("event_id")


@query(
    "p18_all_strings",
    """SELECT event_id, '{"id":"' || event_id || '","ids":["' || event_id || '","' || user_id || '"],"by":{"' || user_id || '":{"even":"' || (CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END) || '","kind":"' || event_type || '"}}}' AS dump FROM events""",
)
def all_strings(spark, sf):
    """Numbers and booleans at any depth, and keys, as strings."""
    even = F.col("event_id") % 2 == 0
    nested = F.struct(F.col("event_id").alias("id"), F.array("event_id", "user_id").alias("ids"), F.create_map("user_id", F.struct(even.alias("even"), F.col("event_type").alias("kind"))).alias("by"))
    rows = t(spark, sf, "events").select("event_id", nested.alias("x"))
    return rows.select("event_id", F.to_json(vr.stringified(F.col("x"), rows.schema["x"].dataType)).alias("dump"))


@query("j05_rows_not_taken", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500 UNION ALL SELECT doc_id FROM documents WHERE contains(text, 'the') AND source = 'src1' UNION ALL SELECT doc_id FROM labels WHERE quality = 1)")
def rows_not_taken(spark, sf):
    """Rows whose index none of three query sets took; an index may stand in several."""
    docs = t(spark, sf, "documents")
    taken = docs.where("lang = 'en' AND n_chars > 500").select("doc_id").union(docs.where(F.col("text").contains("the") & (F.col("source") == "src1")).select("doc_id"))
    taken = taken.union(t(spark, sf, "labels").where("quality = 1").select("doc_id"))
    return docs.select("doc_id").join(taken, "doc_id", "left_anti")


@query("j14_side_by_side", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality FROM (SELECT doc_id, lang FROM documents WHERE lang = 'en') d FULL JOIN labels l ON l.doc_id = d.doc_id")
def side_by_side(spark, sf):
    """Columns of two frames side by side by index; an index that one of them lacks stays, with nulls."""
    left = t(spark, sf, "documents").where("lang = 'en'").select("doc_id", "lang")
    return left.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "full")
