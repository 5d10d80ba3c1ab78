"""Registered queries without SQL against brute force over their whole tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from pairmill.llm import common, fingerprint, neighbours, quality, tokencount

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.documents(spark, SF).select("doc_id", "text").collect()}


def shingles(text, width=5):
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in fingerprint.op1_fingerprints(spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    by_text, errors = {}, []
    for k, i in enumerate(ids):
        text, other = texts[i], texts[ids[(k - 1) % len(ids)] if k else ids[-1]]
        n = len(text) // 3
        # the next document in descending order of ids
        edited = text[: len(text) - n] + other[:n] if n else text
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for found, near in ((r["near_edited"], edited), (r["near_next"], other)):
            a, b = shingles(text), shingles(near)
            if a and b:
                errors.append(abs(found - len(a & b) / len(a | b)))
            assert 0 <= found <= 1
    assert np.mean(errors) < 0.03 and max(errors) < 0.25


def test_token_counts(spark, texts):
    vocabulary = tokencount.unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram([*vocabulary, ("<none>", -1e9)], len(vocabulary), False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.MARK, prepend_scheme="always", split=False)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.op3_token_counts(spark, SF).collect()}
    ids = [i for i in sorted(texts) if len(texts[i]) < 20_000]  # the library's own way over very long texts takes minutes
    assert len(ids) > 0.9 * len(texts)
    assert {i: got[i] for i in ids} == {i: len(e.ids) for i, e in zip(ids, tok.encode_batch([texts[i] for i in ids], add_special_tokens=False))}


def test_quality(spark):
    rows = quality.op2_quality(spark, SF).toPandas()
    trusted = set(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").toPandas().doc_id)
    assert len(rows) == common.documents(spark, SF).count()
    for lang, own in rows.groupby("lang"):
        sure = sorted(own[own.doc_id.isin(trusted) & own.perplexity.notna()].perplexity)
        at = sure[max(1, -(-len(sure) * 985 // 1000)) - 1] if sure else None
        assert at is None or (own.threshold == at).all(), lang
    kept = rows.perplexity.notna() & (rows.perplexity <= rows.threshold)
    assert (rows.kept == kept).all()


def test_neighbours_over_several_blocks(spark):
    """Recall against brute force where rows fill more than one block."""
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    assert table.count() > neighbours.ROWS
    got = neighbours.op10_neighbours(spark, "/root/testdata/check_s").toPandas()
    pdf = table.where(F.col("embedding").isNotNull()).toPandas()
    pdf = pdf[[v is not None and np.isfinite(np.array(v, float)).all() and np.any(v) for v in pdf.embedding]]
    ids, v = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in sorted(set(ids[ids % 50 == 0])):
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        fifth = np.sort(s)[-5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own.score.is_monotonic_decreasing
        hits, total = hits + int((own.score >= fifth - 1e-12).sum()), total + 5
    assert hits / total >= 0.9
