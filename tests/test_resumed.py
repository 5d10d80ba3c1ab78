"""Streams and services that stop halfway: restarts, killed runs, servers that fail on purpose."""

import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairmill.operators import embedded, providers
from pairmill.sources import http
from pairmill.streaming import splits

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not find test modules


def test_stream_stops_within_a_batch(spark, tmp_path, monkeypatch):
    """Rows are written, their counts are not: the batch runs again and nothing is counted twice."""
    rows = spark.range(100).withColumnRenamed("id", "k")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: splits.take_and_skip(stream(), "k", 10, 15, f"{tmp_path}/out", f"{tmp_path}/ck")
    rows.where("k < 7").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    rows.where("k >= 7 and k < 60").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    right, calls = splits._taken, []

    def broken(*a):
        calls.append(a)
        raise OSError("stopped")

    monkeypatch.setattr(splits, "_taken", broken)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(splits, "_taken", right)
    run()
    rows.where("k >= 60").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    got = {r["k"]: r["split"] for r in spark.read.schema("k long, split string").parquet(f"{tmp_path}/out/rows/*").collect()}
    assert calls and got == {k: "validation" if k < 10 else "test" if k < 25 else "train" for k in range(100)}
    assert len(list((tmp_path / "out" / "counts").iterdir())) == 2  # later batches aren't counted


def test_sizes():
    assert splits.sizes(None, 0.05, 0.05) == (1000, 1000) and splits.sizes(None, 0, 0.1) == (0, 1000)
    assert splits.sizes(0, 0.05, 0.05) == (0, 0) and splits.sizes(999, 0.05, 0.1) == (49, 99)
    with pytest.raises(ValueError):
        splits.sizes(10, 0.5, 0.5)


class Counting(providers.HashEmbedder):
    """Counts its calls; fails on a word."""

    def __init__(self, calls, bad=None):
        super().__init__()
        self.calls, self.bad = calls, bad

    async def answer(self, text):
        self.calls.add(1)
        if self.bad and self.bad in text:
            raise ValueError(text)
        return await super().answer(text)


def test_embed_once(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"text {i % 30}" if i % 31 else None) for i in range(200)], "id long, text string")
    path = str(tmp_path / "table")
    calls = spark.sparkContext.accumulator(0)
    with pytest.raises(Exception):  # killed after two parts
        real, n = embedded._commit, []

        def two(*a):
            if len(n) == 2:
                raise RuntimeError("killed")
            n.append(real(*a))

        try:
            embedded._commit = two
            embedded.embed_once(texts, "text", Counting(calls), "m", path)
        finally:
            embedded._commit = real
    kept = embedded.table(spark, path, Counting(calls)).count()
    assert 0 < kept < 31 and len(embedded.committed(spark, path)) == 2
    before = calls.value
    got = embedded.embed_once(texts, "text", Counting(calls), "m", path)
    assert got.where("embedding is not null").count() == 200 and calls.value - before == 31 - kept
    before = calls.value
    assert embedded.embed_once(texts, "text", Counting(calls), "m", path).count() == 200
    assert calls.value == before  # not asked once
    assert embedded.embed_once(texts.limit(5), "text", Counting(calls), "other", path).count() == 5 and calls.value > before


def test_failed_texts_are_asked_again(spark, tmp_path):
    texts = spark.createDataFrame([(1, "good"), (2, "bad one")], "id long, text string")
    calls = spark.sparkContext.accumulator(0)
    got = {r["id"]: r["embedding"] for r in embedded.embed_once(texts, "text", Counting(calls, "bad"), "m", str(tmp_path / "t")).collect()}
    assert got[1] is not None and got[2] is None and calls.value == 2
    assert embedded.embed_once(texts, "text", Counting(calls), "m", str(tmp_path / "t")).where("embedding is null").count() == 0 and calls.value == 3


@pytest.fixture
def server():
    """Answers by path: fine, empty, missing, failing, failing twice and then fine, busy, cutting the line."""
    seen, lock = {}, threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            kind = self.path.split("/")[1]
            with lock:
                seen[self.path] = n = seen.get(self.path, 0) + 1
            if kind == "cut":
                self.connection.close()
                return
            body, status, more = b"<r><item><title>a &amp; b</title></item><item><title>c</title></item><item/></r>", 200, {}
            if kind == "missing":
                body, status = b"no", 404
            elif kind == "broken" or kind == "twice" and n <= 2:
                body, status = b"oh", 500
            elif kind == "busy" and n == 1:
                body, status, more = b"", 429, {"Retry-After": "0"}
            elif kind == "refused":
                body, status = b"", 403
            elif kind == "empty":
                body = b"<r></r>"
            elif kind == "text":
                body = b"not xml"
            self.send_response(status)
            for k, v in {**more, "Content-Length": str(len(body))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_enrichment_over_http(spark, server):
    at, seen = server
    kinds = ["good", "empty", "missing", "broken", "twice", "busy", "refused", "cut", "text"]
    rows = [(i, f"{at}/{k}/{i}") for i, k in enumerate(kinds * 5)] + [(1_000, None), (1_001, "http://127.0.0.1:9/none")]
    df = spark.createDataFrame(rows, "id long, url string").repartition(3)
    got = {r["id"]: r for r in http.related(http.fetched(df, "url", tries=3, pause=0.01, timeout=5), "item", "title").collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    for i, k in enumerate(kinds * 5):
        want = {"good": (200, ["a & b", "c"], 1), "empty": (200, [], 1), "missing": (404, [], 1), "broken": (None, None, 3), "twice": (200, ["a & b", "c"], 3), "busy": (200, ["a & b", "c"], 2), "refused": (None, None, 1), "cut": (None, None, 3), "text": (200, None, 1)}[k]
        assert (got[i]["http_status"], got[i]["related"], got[i]["tries"]) == want, k
        assert seen[f"/{k}/{i}"] == want[2]  # no more calls than tries
    assert got[1_000]["related"] is None and got[1_000]["tries"] == 0 and got[1_001]["related"] is None
    assert http.fetched(df.where(F.lit(False)), "url").collect() == []


def test_calls_a_second(server):
    at, _ = server
    import time

    client = http.Client(1, 0.01, 5, 50)
    began = time.monotonic()
    assert all(client.get(f"{at}/good/{i}")[0] == 200 for i in range(11))
    assert time.monotonic() - began >= 0.19
