"""Byte-level BPE against the library, text by text, and the round trip back to bytes."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from pairmill.llm import bytebpe, common

PATH = public_tokenizers.path(bytebpe.VOCABULARY)
SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "\n\n\ta \n b\r\n", "don't we'll 'sx I'M", "x" * 5_000, "ab" * 40_000, "<|endoftext|> x", "1234567 12 ½²", "日本語 のテキスト　と", "é é \U0001f600\U0001f468‍\U0001f469", "\x00\x1c \x1d\x85\xa0x", "!!! ??? a.b,c", "   x﻿", "tail\n", "same text", "same text"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_documents(spark):
    """Repeated and null ids, all odd texts, columns with clashing names; more partitions than rows in some."""
    rows = [(i // 2 if i % 5 else None, t, "b", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, ids int").repartition(5)


def test_ids_are_the_librarys(spark, library):
    got = sorted((r["doc_id"] or -1, list(r["ids"])) for r in bytebpe.encode(odd_documents(spark), PATH).collect())
    assert got == sorted((r["doc_id"] or -1, library.encode_ordinary(r["text"] or "")) for r in odd_documents(spark).collect())


def test_round_trip(spark):
    got = bytebpe.decode(bytebpe.encode(odd_documents(spark), PATH), PATH)
    assert sorted((r["doc_id"] or -1, bytes(r["bytes"]).decode()) for r in got.collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_documents(spark).collect())


def test_ids_out_of_the_vocabulary(spark):
    rows = spark.createDataFrame([(1, [64, 65]), (2, [70_000]), (3, [-1]), (4, None), (5, []), (6, [64, None])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["bytes"] for r in bytebpe.decode(rows, PATH).collect()} == {1: b"ab", 2: None, 3: None, 4: None, 5: b"", 6: None}


def test_query(spark, library):
    want = []
    for r in common.documents(spark, SF).select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in bytebpe.op11_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_one_exchange_of_blocks(spark):
    """Documents are cut once: the words come from the exchange that the places are in."""
    df = bytebpe.op11_byte_bpe(spark, SF)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.encode(none, PATH).collect() == [] and bytebpe.digests(none, PATH).collect() == []
    assert bytebpe.decode(spark.createDataFrame([], "doc_id long, ids array<int>"), PATH).collect() == []
