"""Data sources: pages over HTTP and from folders, Arrow folders with commit and abort, the table function."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from pairmill.operators.assembly import assembled
from pairmill.sources import datasource
from pairmill.sources.loading import Loader, available, load


@pytest.fixture(autouse=True)
def registered(spark):
    datasource.register(spark)


@pytest.fixture
def pages():
    """Pages of two splits; the second page of train fails once."""
    data = {"train": [[{"id": 1, "t": "ä"}, {"id": 2, "t": None}], [{"id": 3, "t": "c"}], []], "dev": [[{"id": 9, "t": "z"}]]}
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            split, page = url.path.strip("/").split("/")[-1], int(parse_qs(url.query)["page"][0])
            seen.append((split, page))
            fine = split in data and not (page == 1 and seen.count((split, 1)) == 1)
            body = json.dumps({"pages": len(data[split]), "rows": data[split][page]}).encode() if fine else b""
            self.send_response(200 if fine else 404 if split not in data else 503)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/data", seen
    s.shutdown()


def test_pages_over_http(spark, pages):
    at, seen = pages
    rows = spark.read.format("pages").option("path", at).option("splits", "train,dev").option("records", "rows").load()
    got = sorted((r["split"], r["page"], json.loads(r["record"])["id"]) for r in rows.collect())
    assert got == [("dev", 0, 9), ("train", 0, 1), ("train", 0, 2), ("train", 1, 3)] and seen.count(("train", 1)) == 2
    seen.clear()
    assert rows.where("split = 'dev'").count() == 1 and {s for s, _ in seen} == {"dev"}  # the filter reached the source
    with pytest.raises(Exception):
        spark.read.format("pages").option("path", at).option("splits", "none").option("records", "rows").load().collect()


def test_pages_of_a_folder(spark, tmp_path):
    for split, n in (("a", 3), ("b", 1)):
        (tmp_path / split).mkdir()
        for k in range(n):
            (tmp_path / split / f"p{k}.json").write_text(json.dumps({"records": [{"k": k}] * (k + 1)}))
    df = spark.read.format("pages").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 4 and df.groupBy("split").count().orderBy("split").collect() == [("a", 6), ("b", 1)]
    with pytest.raises(Exception, match="no split c"):
        spark.read.format("pages").option("path", str(tmp_path)).option("splits", "a,c").load().collect()


def test_arrow_folder(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 7 == 0, "test").when(F.col("id") % 11 != 0, "train").alias("split"), F.array("id").alias("ids")).repartition(5)
    rows.write.format("arrow_folder").mode("overwrite").option("path", path).save()
    back = spark.read.format("arrow_folder").schema("id long, ids array<long>, split string").option("path", path)
    assert sorted(map(str, back.load().select("id", "split", "ids").collect())) == sorted(map(str, rows.fillna("none", ["split"]).collect()))
    assert back.option("splits", "test").load().count() == 143
    info = json.loads((tmp_path / "set" / "dataset_info.json").read_text())["splits"]
    assert sum(info.values()) == 1_000 and info["test"] == 143
    assert sorted(p.name for p in (tmp_path / "set").iterdir()) == ["dataset_info.json", "none", "test", "train"]
    rows.limit(10).write.format("arrow_folder").mode("append").option("path", path).save()
    assert back.option("splits", "").load().count() == 1_010
    rows.limit(10).write.format("arrow_folder").mode("overwrite").option("path", path).save()
    assert spark.read.format("arrow_folder").schema("id long").option("path", path).load().count() == 10


def test_aborted_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "set")
    good = spark.range(20).withColumn("split", F.lit("train"))
    good.write.format("arrow_folder").mode("overwrite").option("path", path).save()
    bad = spark.range(2_000).repartition(4).select(F.when(F.col("id") == 1_500, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"), F.lit("train").alias("split"))
    with pytest.raises(Exception):
        bad.write.format("arrow_folder").mode("append").option("path", path).save()
    assert spark.read.format("arrow_folder").schema("id long, split string").option("path", path).load().count() == 20
    assert not (tmp_path / "set" / "_temporary").exists()


def test_records_of_a_dump(spark):
    lines = ["before", "/A/1|u|x", "more", "", "/B/2|only two", "/A/3|u|y|too many", "/A/4|v|", "/B/5|w|last"]
    df = spark.createDataFrame([(f, n, x) for f in ("f", "g") for n, x in enumerate(lines)] + [("h", 0, None), ("h", 1, "nothing")], "file string, line int, text string").repartition(6)
    got = sorted(tuple(r) for r in assembled(spark, df, ["/A/", "/B/"], "|", 3).collect())
    want = [(1, "/A/1", "u", "x\\nmore\\n"), (2, "/A/4", "v", ""), (3, "/B/5", "w", "last")]
    assert got == [(f, *w) for f in ("f", "g") for w in want]
    assert assembled(spark, df, ["/A/"], "|", 2).columns == ["file", "record", "field1", "field2"]


def test_splits_and_slices(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "k")
    for c, s, w in (("x", "train", "k < 80"), ("x", "test", "k >= 80"), ("y", "train", "k < 5")):
        rows.where(w).write.parquet(f"{tmp_path}/{c}/{s}")
    loader = Loader("d", str(tmp_path), "k long", order="k")
    ids = lambda split, c="x": sorted(r["k"] for r in load(spark, loader, split, c).collect())
    assert available(loader, "x") == ["test", "train"] and available(loader, "y") == ["train"]
    assert ids("train[:10]") == list(range(10)) and ids("train[10%:20%]") == list(range(8, 16)) and ids("train[-3:]") == [77, 78, 79]
    assert ids("train[75:]+test[:-18]") == [75, 76, 77, 78, 79, 80, 81] and ids("train", "y") == list(range(5))
    for wrong in ("dev", "train[", "a b"):
        with pytest.raises(ValueError):
            load(spark, loader, wrong, "x")
    with pytest.raises(ValueError):
        load(spark, Loader("d", str(tmp_path), "k long"), "train[1:]", "x")


def test_many_small_files_lie_in_folders(spark, tmp_path):
    """commit moves folders and tasks list them; files and their contents are as those of one folder."""
    from pairmill.sources import datasource, readers

    datasource.register(spark)
    one = lambda n: json.dumps({"Terms": [{"Term": f"t{n}", "Definition": "d\n"}]})
    rows = spark.createDataFrame([(f"{n}.json", one(n).encode()) for n in range(95)], "name string, content binary").repartition(3)
    at = str(tmp_path / "many")
    rows.write.format("made_files").mode("append").option("path", at).option("filesPerFolder", 10).save()
    rows.where("name = '7.json'").withColumn("name", F.lit("loose.json")).write.format("made_files").mode("append").option("path", at).save()
    top = [p for p in (tmp_path / "many").iterdir()]
    assert 10 <= sum(p.is_dir() for p in top) <= 13 and [p.name for p in top if p.is_file()] == ["loose.json"]
    got = {r["file"].rsplit("/", 1)[1]: (r["term"], r["definition"]) for r in readers.vocabulary_of(spark.read.format("made_files").load(at)).collect()}
    assert got == {f"{n}.json": (f"t{n}", "d\n") for n in range(95)} | {"loose.json": ("t7", "d\n")}
    (tmp_path / "list.json").mkdir()
    (tmp_path / "list.json" / "a.json").write_text(f"[{one(1)}, {one(2)}]")
    assert readers.vocabulary_of(spark.read.format("made_files").load(str(tmp_path / "list.json"))).count() == 2
