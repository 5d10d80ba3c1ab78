"""Record files are cut by bytes: long texts over many files, each file small but for its last record."""

import os
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairmill.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_files_are_cut_by_bytes(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta "
    rows = [(i, words * (40_000 if i in (3, 4, 11) else i), None) for i in range(60)]  # three texts of 2 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string").repartition(3)
    limit = 50_000
    index = records.write_with_index(docs, str(tmp_path), PATH, 0, limit)
    got = {r["doc_id"]: r for r in index.collect()}
    tok = Tokenizer.from_file(PATH)
    start = 0
    for i, text, _ in rows:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    longest = {}
    for r in got.values():
        longest[r["file"]] = max(longest.get(r["file"], 0), r["length"])
    sizes = {f: os.path.getsize(tmp_path / "records" / f) for f in os.listdir(tmp_path / "records") if f.startswith("part-")}
    assert len(sizes) > 3 and all(n <= limit + longest[f] + 1 for f, n in sizes.items())
    some = index.where(F.col("doc_id").isin(2, 4, 59))
    fetched = {r["doc_id"]: r["tokens"] for r in records.fetch(spark, str(tmp_path), some).collect()}
    assert sorted(fetched) == [2, 4, 59] and all(list(v) == [*tok.encode(rows[k][1], add_special_tokens=False).ids, 0] for k, v in fetched.items())
