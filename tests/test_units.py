"""Worked cases, invariants of samples, and round trips of readers and writers."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.functions import vectors as vx
from pairmill.operators import providers, retrieval, sampling
from pairmill.sources import readers, writers
from pairmill.streaming import incremental


def one(spark, col, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).select(col).first()[0]


def test_metrics_with_two_relevant(spark):
    ranked = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(["c4", "c6", "c1", "c8", "c2"])], "query_id string, corpus_id string, rank int")
    relevant = spark.createDataFrame([("q", "c1"), ("q", "c2")], "query_id string, corpus_id string")
    got = {r["k"]: r for r in retrieval.metrics(ranked, relevant, [1, 3, 5]).collect()}
    want = {1: (0, 0, 0, 0, 0, 0), 3: (1, 1 / 3, 0.5, 1 / 3, 0.306574, 1 / 6), 5: (1, 0.4, 1, 1 / 3, 0.543771, 0.366667)}
    for k, w in want.items():
        assert [got[k][m] for m in ("accuracy", "precision", "recall", "mrr", "ndcg", "map")] == pytest.approx(w, abs=2e-6)


def test_query_without_hits_counts(spark):
    ranked = spark.createDataFrame([("q", "c1", 1)], "query_id string, corpus_id string, rank int")
    relevant = spark.createDataFrame([("q", "c1"), ("p", "c9")], "query_id string, corpus_id string")
    assert retrieval.metrics(ranked, relevant, [1]).first()["accuracy"] == 0.5


def test_hamming(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vx.hamming(F.col("a"), F.col("b")), a=arr(255, 0), b=arr(255, 128)) == 15
    assert one(spark, vx.hamming(F.col("a"), F.col("b")), a=arr(0b10101000), b=arr(0b11001000)) == 6
    assert one(spark, vx.packed_bytes(F.col("a")), a=arr(1.0, -1.0, 0.0, -2.0, 1.0, -1.0, -1.0, -1.0)) == [0b10101000 - 256]
    assert one(spark, vx.packed_bytes(F.col("a"), at_zero=False), a=arr(1.0, -1.0, 0.0, -2.0, 1.0, -1.0, -1.0, -1.0)) == [0b10001000 - 256]
    assert one(spark, vx.unpacked(F.col("a")), a=arr(-88)) == [1, 0, 1, 0, 1, 0, 0, 0]
    assert one(spark, F.size(vx.padded(F.col("a"))), a=arr(1.0, 2.0)) == 8
    assert one(spark, vx.signs(F.col("a")), a=arr(-2.0, 0.0, 3.0)) == [-1, 0, 1]


def test_weighted_batches(spark):
    rows = spark.createDataFrame([(s, f"{s}{i}") for s, n in (("a", 60), ("b", 30), ("c", 10)) for i in range(n)], "source string, id string")
    weights = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 3.0)], "source string, weight double")
    got = sampling.weighted_batches(rows, "source", "id", 4, weights)
    n = {r[0]: r[1] for r in got.groupBy("source").agg(F.count_distinct("batch_seq")).collect()}
    assert n == {"a": 8, "b": 8, "c": 9}
    assert got.agg(F.max("batch_seq")).first()[0] == 24


def test_quota():
    assert sampling.quota([1000, 1000, 1000, 1000], 750) == [187, 187, 187, 189]
    assert sampling.quota([10, 1000], 100) == [10, 90]


def test_split_is_stable(spark):
    df = spark.range(2000)
    a = {r["id"]: r["split"] for r in sampling.split_by_hash(df, "id", 0.05, 0.05).collect()}
    b = {r["id"]: r["split"] for r in sampling.split_by_hash(df.repartition(7), "id", 0.05, 0.05).collect()}
    assert a == b and set(a.values()) == {"train", "validation", "test"}
    assert set(sampling.split_by_hash(df, "id", 0.0, 0.0).select("split").distinct().toPandas()["split"]) == {"train"}


def test_text_rules(spark):
    assert one(spark, tx.blank_words(F.col("t")), t=F.lit("a  b")) == 3
    assert one(spark, tx.space_words(F.col("t")), t=F.lit(" a  b\n")) == 2
    assert one(spark, tx.without_extension(F.col("t")), t=F.lit("nodot")) == ""
    assert one(spark, tx.url_remainder(F.col("t")), t=F.lit("https://h.org/a?b=1#c")) == "/a?b=1#c"
    assert one(spark, tx.canonical_url(F.col("t")), t=F.lit("http://WWW.Host.org:80/a/?z=1&b=&a=2#x")) == "https://host.org/a?a=2&z=1"
    assert json.loads(one(spark, tx.merged_json(F.col("t"), {"b": F.lit("2")}), t=F.lit('{"a":"1","b":"x"}'))) == {"a": "1", "b": "2"}
    assert one(spark, tx.labelled_lines({"A": F.col("t"), "B": F.col("u")}), t=F.lit("x"), u=F.lit("")) == "A: x"


def test_repair(spark, tmp_path):
    (tmp_path / "dump.txt").write_text("junk\n/SDE/༜a༜first\nsecond\n/scrapers/༜b༜x\n/SDE/༜short\n")
    got = readers.repaired_records(readers.numbered_lines(spark, str(tmp_path / "dump.txt")), ["/SDE/", "/scrapers/"], "༜", 3)
    assert sorted(r["fields"][1] for r in got.collect()) == ["a", "b"]


def test_xml(spark, tmp_path):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><DateCompleted><Year>1999</Year></DateCompleted><Article><ArticleTitle>x <b>i</b></ArticleTitle>
    <Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract></Article></MedlineCitation>
    <PubmedData><ReferenceList><Reference><Citation>c</Citation><ArticleIdList><ArticleId>12</ArticleId><ArticleId>x1</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>"""
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(xml)
    r = readers.articles(spark, str(tmp_path / "a.xml.gz")).first()
    assert (r["pmid"], r["title"], r["abstract"], r["year"]) == ("7", "x <b>i</b>", "one two", 1999)
    assert [(x["citation"], x["id"]) for x in r["references"]] == [("c", 12)]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        for name, raw in (("a.txt", "é".encode()), ("b.txt", b"\xe9")):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    manifest = spark.createDataFrame([("a.txt", "1"), ("b.txt", "2")], "path string, pmid string")
    assert sorted((r["pmid"], r["text"]) for r in readers.tar_texts(spark, str(tmp_path / "t.tar.gz"), manifest).collect()) == [("1", "é"), ("2", "é")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "id,name\n1,x\n2,\n")
    assert [tuple(r) for r in readers.zipped_csv(spark, str(tmp_path / "z.zip"), "id int, name string").orderBy("id").collect()] == [(1, "x"), (2, None)]


def test_vocabularies_and_answers(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"Terms": [{"Term": "a", "Definition": "x"}, {"Term": "b", "Definition": "y"}]}))
    assert readers.vocabulary(spark, str(tmp_path / "v.json")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"concepts": [{"prefLabel": "l", "definitions": [{"text": "d1"}, {"text": "d2"}]}, {"prefLabel": "m", "definitions": []}]}))
    assert [tuple(r) for r in readers.concepts(spark, str(tmp_path / "c.json")).collect()] == [("l", "d1")]
    nested = spark.createDataFrame(
        [((["q1"], [[(["e"], ["h", "h"])]]),)], "qas struct<question:array<string>, answers:array<array<struct<evidence:array<string>,highlighted_evidence:array<string>>>>>"
    )
    assert [tuple(r) for r in readers.flat_answers(nested).collect()] == [("q1", "h")]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", None), ("", "b", None), ("c", "d", None)], readers.PAIR)
    writers.jsonl(df, str(tmp_path / "p"))
    spec = readers.SourceSpec("p", str(tmp_path / "p"), "json", readers.PAIR)
    assert readers.load_all(spark, [spec]).count() == 2
    assert readers.materialised(spark, spec, str(tmp_path / "kept")).count() == 2
    assert readers.materialised(spark, spec, str(tmp_path / "kept")).count() == 2
    rels = spark.createDataFrame([("q0", "c0", 1, "x"), ("q9", "c1", 1, "y")], "`query-id` string, `corpus-id` string, score int, type string")
    writers.qrels(rels.drop("type"), str(tmp_path / "q"))
    back = readers.qrels(spark, str(tmp_path / "q"))
    assert back.count() == 2
    queries = spark.createDataFrame([("q0", "text")], "_id string, text string")
    assert sorted(r["query"] for r in readers.benchmark(queries, back).collect()) == ["", "text"]
    writers.qrels(rels, str(tmp_path / "by"), ["type"])
    assert (tmp_path / "by" / "type=x").exists()
    assert writers.append_new(df.where("anchor <> ''"), str(tmp_path / "s"), ["anchor"]) == 2
    assert writers.append_new(df.where("anchor <> ''"), str(tmp_path / "s"), ["anchor"]) == 0
    assert writers.markdown(spark.createDataFrame([("m", 0.5)], "model string, mrr double")).endswith("| m | 0.5000 |")
    assert readers.dated_before(["base.tar.gz", "x.2022-01-01.gz", "x.2023-01-01.gz"], "2022-06-01") == ["base.tar.gz", "x.2022-01-01.gz"]
    top = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.9)], "query_id string, corpus_id string, score double")
    writers.predictions(top, str(tmp_path / "pred"))
    assert spark.read.json(str(tmp_path / "pred")).first()["results"][0]["corpus_id"] == "b"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"a{i}", "b", None) for i in range(50)], readers.PAIR)
    df.write.parquet(str(tmp_path / "in"))
    spec = readers.SourceSpec("s", str(tmp_path / "in"), "parquet", readers.PAIR)
    for _ in range(2):  # the second run finds nothing new
        incremental.drain(incremental.pair_stream(spark, spec, 0.1, 0.1), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_providers_resume_and_isolate(spark, tmp_path):
    class Broken(providers.WordCounter):
        async def answer(self, text):
            if text == "bad":
                raise ValueError(text)
            return await super().answer(text)

    todo = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None)], "id long, text string")
    got = {r["id"]: (r["tokens"], r["status"]) for r in providers.enrich(todo, "id", "text", Broken()).collect()}
    assert got == {1: (2, "ok"), 2: (None, "ValueError"), 3: (0, "ok")}
    for _ in range(2):
        out = incremental.resumable(todo, "id", "text", providers.LengthJudge(), str(tmp_path / "r"), 2)
    assert out.count() == 3
