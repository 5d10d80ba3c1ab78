"""Queries: tables written out as archives, pages, splits, dumps and Arrow folders, and read by their sources."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from pairmill.operators.assembly import assembled
from pairmill.plans.curate import t
from pairmill.plans.places import folder
from pairmill.plans.registry import query
from pairmill.sources import datasource, readers, writers
from pairmill.sources.datasource import _listed
from pairmill.sources.loading import Loader, available, configs, load, load_all

#: Rows of an archive or a page.
MANY = 200


def _files(rows, path, many=0):
    """Rows (name, content) as files of a folder; many: in folders of so many, for very many small files."""
    datasource.register(rows.sparkSession)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("made_files").mode("append").option("path", path).option("filesPerFolder", many).save()


def _made(rows, key, make, suffix):
    """(name, content): files of about MANY rows each, made group by group; make(pdf) gives the bytes."""
    cells = F.floor(F.col(key) / MANY)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{int(pdf['cell__'].iloc[0]):08d}{suffix}"], "content": [make(pdf.drop(columns="cell__").sort_values(key))]})

    return rows.withColumn("cell__", cells).groupBy("cell__").applyInPandas(run, "name string, content binary")


@query("s03_zipped_csv", "SELECT p_partkey, p_name, p_size FROM part")
def zipped_csv(spark, sf):
    def make(pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, half in enumerate((pdf.iloc[: len(pdf) // 2], pdf.iloc[len(pdf) // 2 :])):
                z.writestr(f"rows{k}.csv", half.to_csv(index=False))
            z.writestr("readme.txt", "not a table")
        return out.getvalue()

    path = folder(spark, "s03")
    _files(_made(t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", make, ".zip"), path)
    return readers.zipped_csv(spark, f"{path}/*.zip", "p_partkey long, p_name string, p_size int")


@query("s11_tar_with_manifest", "SELECT item_id, 'items/' || item_id || '.txt' AS path, text FROM benchmark WHERE item_id % 5 <> 4")
def tar_with_manifest(spark, sf):
    """Texts in tar.gz archives, some in Latin-1, and a manifest in CSV that lists most of them."""

    def make(pdf):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for i, text in zip(pdf["item_id"], pdf["text"]):
                raw = text.encode("latin-1" if i % 3 == 0 else "utf-8", "replace")
                raw = raw if readers.decoded(raw) == text else text.encode()
                info = tarfile.TarInfo(f"items/{i}.txt")
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
        return out.getvalue()

    path = folder(spark, "s11")
    rows = t(spark, sf, "benchmark").select("item_id", "text")
    _files(_made(rows, "item_id", make, ".tar.gz"), f"{path}/archives")
    listed = rows.where("item_id % 5 <> 4").select("item_id", F.concat(F.lit("items/"), F.col("item_id"), F.lit(".txt")).alias("path"))
    writers.csv(listed, f"{path}/manifest")
    return readers.tar_texts(spark, f"{path}/archives/*.tar.gz", readers.csv(spark, f"{path}/manifest", "item_id long, path string"))


@query("s10_articles", "SELECT conv_id::VARCHAR AS pmid, 'About ' || conv_id || ' & more' AS title, string_agg(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ' ORDER BY turn, role) AS abstract, (2000 + conv_id % 20)::INTEGER AS year, 1::BIGINT AS authors FROM conversations WHERE conv_id % 7 <> 3 AND text <> '' GROUP BY conv_id")
def articles(spark, sf):
    """Articles in gzipped XML; every seventh file's article is broken off and left out."""
    import gzip

    def make(pdf):
        out = ["<PubmedArticleSet>"]
        for r in pdf.itertuples():
            if r.conv_id % 7 == 3:
                out.append(f"<PubmedArticle><MedlineCitation><PMID>{r.conv_id}</PMID><DateCompleted><Year>no year</Year></DateCompleted></MedlineCitation></PubmedArticle>")
                continue
            parts = "".join(f"<AbstractText>{x}</AbstractText>" for x in r.parts)
            out.append(f"<PubmedArticle><MedlineCitation><PMID>{r.conv_id}</PMID><DateCompleted><Year>{2000 + r.conv_id % 20}</Year><Month>1</Month><Day>2</Day></DateCompleted><Article><ArticleTitle>About {r.conv_id} &amp; more</ArticleTitle><Abstract>{parts}</Abstract><AuthorList><Author><LastName>Roe</LastName><ForeName>A.</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>")
        return gzip.compress(("\n".join(out) + "\n</PubmedArticleSet>\n").encode())

    path = folder(spark, "s10")
    clean = F.replace(F.replace(F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = t(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", clean.alias("x")))), lambda s: s["x"]).alias("parts"))  # a conversation's turns
    _files(_made(rows, "conv_id", make, ".xml.gz"), path)
    return readers.articles(spark, f"{path}/*.xml.gz").select("pmid", "title", "abstract", "year", F.size("authors").cast("long").alias("authors"))


_STARTS, _SEP = ["/SDE/", "/SDE-TDAMM/"], "༜"
_BROKEN = r"""SELECT (CASE WHEN page_id % 2 = 0 THEN '/SDE/' ELSE '/SDE-TDAMM/' END) || page_id AS field1, url AS field2, replace(replace(html, '</p>', '</p>' || chr(10)), chr(10), '\n') AS field3 FROM pages WHERE page_id % 6 <> 5"""


@query("x06_records_of_a_broken_dump", _BROKEN)
def records_of_a_broken_dump(spark, sf):
    """Pages as a dump whose records run over lines and sometimes lack a field, put together by a table function."""
    path = folder(spark, "x06")
    rows = t(spark, sf, "pages")
    head = F.concat(F.when(F.col("page_id") % 2 == 0, _STARTS[0]).otherwise(_STARTS[1]), F.col("page_id").cast("string"))
    body = F.replace("html", F.lit("</p>"), F.lit("</p>\n"))
    record = F.when(F.col("page_id") % 6 == 5, F.concat(head, F.lit(_SEP), body)).otherwise(F.concat_ws(_SEP, head, "url", body))
    dump = rows.select("page_id", record.alias("record"))

    def make(pdf):
        return ("a line before the first record\n" + "\n".join(pdf["record"])).encode()

    _files(_made(dump, "page_id", make, ".csv"), path)
    return assembled(spark, readers.numbered_lines(spark, f"{path}/*.csv"), _STARTS, _SEP, 3).select("field1", "field2", "field3")


@query("s13_baseline_and_updates", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 < 3")
def baseline_and_updates(spark, sf):
    """A baseline folder and dated updates; those after the cut-off stay out."""
    path = folder(spark, "s13")
    rows = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for k, name in enumerate(("baseline", "update_2024-01-05", "update_2024-02-01", "update_2024-03-01")):
        rows.where(F.pmod("o_orderkey", F.lit(4)) == k).write.parquet(f"{path}/{name}")
    taken = readers.dated_before([f"{path}/{f.base_name}" for f in _listed(path)], "2024-02-15")
    return spark.read.schema(rows.schema).parquet(*taken)


@query("s19_vocabulary", "SELECT p_partkey || '.json' AS file, 'term ' || p_name AS term, p_type AS definition FROM part")
def vocabulary(spark, sf):
    """A JSON file for each part with its terms."""
    path = folder(spark, "s19")
    one = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("term "), "p_name").alias("Term"), F.col("p_type").alias("Definition"))).alias("Terms")))
    rows = t(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("name"), one.alias("content"))
    _files(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name"), path, datasource.FILES)
    return readers.vocabulary_of(spark.read.format("made_files").load(path)).withColumn("file", F.element_at(F.split("file", "/"), -1))


@query("s22_nested_answers", "SELECT DISTINCT 'why ' || p_name AS question, p_type AS evidence FROM part")
def nested_answers(spark, sf):
    rows = t(spark, sf, "part")
    answer = F.struct(F.array("p_type", "p_type").alias("evidence"), F.lit(None).cast("array<string>").alias("highlighted_evidence"))
    asked = F.struct(F.array(F.concat(F.lit("why "), "p_name"), F.lit("")).alias("question"), F.array(F.array(answer), F.array(answer)).alias("answers"))
    path = folder(spark, "s22")
    writers.jsonl(rows.select(asked.alias("qas")), path)
    return readers.flat_answers(readers.jsonl(spark, path, "qas struct<question: array<string>, answers: array<array<struct<evidence: array<string>, highlighted_evidence: array<string>>>>>"))


@query("s18_pages_of_concepts", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'dev' ELSE 'train' END AS split, c_name AS label, c_mktsegment AS definition FROM customer WHERE c_custkey % 4 <> 1")
def pages_of_concepts(spark, sf):
    """A vocabulary in pages of JSON by split, read page by page; concepts without a definition are left out."""

    def make(pdf):
        import json

        each = [{"prefLabel": n, "definitions": [{"text": s}, {"text": "other"}] if k % 4 != 1 else []} for k, n, s in zip(pdf["c_custkey"], pdf["c_name"], pdf["c_mktsegment"])]
        return json.dumps({"concepts": each}).encode()

    path = folder(spark, "s18")
    rows = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    for split, own in (("dev", rows.where("c_custkey % 3 = 0")), ("train", rows.where("c_custkey % 3 <> 0"))):
        _files(_made(own, "c_custkey", make, ".json"), f"{path}/{split}")
    got = spark.read.format("pages").option("path", path).option("records", "concepts").option("splits", "dev,train").load()
    c = F.from_json("record", "prefLabel string, definitions array<struct<text: string>>")
    return got.select("split", c.alias("c")).select("split", F.col("c.prefLabel").alias("label"), F.try_element_at("c.definitions", F.lit(1))["text"].alias("definition")).where("definition IS NOT NULL")


def _loader(spark, sf, name):
    """documents in folders by language and split; one language has no test split."""
    path = folder(spark, name)
    split = F.when((F.pmod("doc_id", F.lit(10)) == 0) & (F.col("lang") != "de"), "test").otherwise("train")
    rows = t(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", "source", F.col("lang").alias("config"), split.alias("part"))
    for lang in ("de", "en", "es", "fr"):
        for s in ("train", "test"):
            if (lang, s) != ("de", "test"):
                rows.where((F.col("config") == lang) & (F.col("part") == s)).select("doc_id", "source").write.parquet(f"{path}/{lang}/{s}")
    return Loader("documents", path, "doc_id long, source string", order="doc_id")


_LOADED = "(SELECT doc_id, source, lang AS config, CASE WHEN doc_id % 10 = 0 AND lang <> 'de' THEN 'test' ELSE 'train' END AS split FROM documents WHERE lang IN ('de', 'en', 'es', 'fr'))"


@query("s09_splits", f"SELECT config, split, count(l.doc_id)::BIGINT AS n FROM (SELECT c AS config, s AS split FROM (SELECT unnest(['de', 'en', 'es', 'fr']) AS c), (SELECT unnest(['train', 'test']) AS s) WHERE c <> 'de' OR s <> 'test') a LEFT JOIN {_LOADED} l USING (config, split) GROUP BY 1, 2")
def splits(spark, sf):
    """The splits that each configuration has, with their rows."""
    loader, out = _loader(spark, sf, "s09"), None
    for c in configs(loader):
        for s in available(loader, c):
            one = load(spark, loader, s, c).agg(F.count("*").alias("n")).select(F.lit(c).alias("config"), F.lit(s).alias("split"), "n")
            out = one if out is None else out.unionByName(one)
    return out


@query("s14_slices_of_splits", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY split) AS n FROM {_LOADED} WHERE config = 'en') SELECT doc_id, source, split FROM p WHERE split = 'train' AND place < 40 OR split = 'test' AND place >= round(n * 0.1) AND place < n - 5")
def slices_of_splits(spark, sf):
    return load(spark, _loader(spark, sf, "s14"), "train[:40]+test[10%:-5]", "en")


@query("s17_all_configurations", f"SELECT doc_id, source, split, config FROM {_LOADED} WHERE split = 'test'")
def all_configurations(spark, sf):
    return load_all(spark, _loader(spark, sf, "s17"), "test")


@query("k09_arrow_folder", "SELECT doc_id, text, lang, coalesce(source, 'none') AS split FROM documents")
def arrow_folder(spark, sf):
    """documents as Arrow files by source, written with commit and read back."""
    path = folder(spark, "k09")
    datasource.register(spark)
    rows = t(spark, sf, "documents").select("doc_id", "text", "lang", F.col("source").alias("split"))
    rows.write.format("arrow_folder").mode("overwrite").option("path", path).save()
    return spark.read.format("arrow_folder").schema("doc_id long, text string, lang string, split string").option("path", path).load()


_RELS = "SELECT 'q' || conv_id AS \"query-id\", 'c' || conv_id || '_' || turn AS \"corpus-id\", (turn % 3)::INTEGER AS score, CASE WHEN conv_id % 5 = 0 THEN 'dev' WHEN conv_id % 5 = 1 THEN 'test' ELSE 'train' END AS split, role AS data_source FROM conversations"


def _rels(spark, sf):
    split = F.when(F.col("conv_id") % 5 == 0, "dev").when(F.col("conv_id") % 5 == 1, "test").otherwise("train")
    rows = t(spark, sf, "conversations")
    return rows.select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("query-id"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("corpus-id"), F.pmod("turn", F.lit(3)).cast("int").alias("score"), split.alias("split"), F.col("role").alias("data_source"))


@query("k04_judgements_by_split", f'SELECT "query-id", "corpus-id", score, split FROM ({_RELS})')
def judgements_by_split(spark, sf):
    """A judgement file for each split, each read alone."""
    path, out = folder(spark, "k04"), None
    rows = _rels(spark, sf)
    for s in ("train", "dev", "test"):
        writers.qrels(rows.where(F.col("split") == s).select("query-id", "corpus-id", "score"), f"{path}/{s}.tsv")
        one = readers.qrels(spark, f"{path}/{s}.tsv").withColumn("split", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query("k07_judgements_by_source", f'SELECT data_source, split, count(*)::BIGINT AS n, sum(score)::BIGINT AS total FROM ({_RELS}) GROUP BY 1, 2')
def judgements_by_source(spark, sf):
    """Folders by source and split in one write; one source's file is read without the others."""
    path = folder(spark, "k07")
    writers.qrels(_rels(spark, sf), path, by=["data_source", "split"])
    rows = spark.read.csv(path, schema="`query-id` string, `corpus-id` string, score int, data_source string, split string", sep="\t", header=True)
    return rows.groupBy("data_source", "split").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
