"""Alignment of two tokenizers against a walk over both token lists, text by text."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairmill.llm import alignment, common

PATHS = public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE)
SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "tabs\tand\nlines \n x\r\n", "don't we'll I'M", "x" * 3_000, "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b and c", "▁", "1234567 12 ½²", "日本語 のテキスト　と", "é é \U0001f600\U0001f468‍\U0001f469 naïveté", "\x00\x1c \x1d\x85\xa0x", "!!! ??? a.b,c", "tail\n", "same text here", "same text here", "def f():\n    return  1"]


class Plain:
    """Both libraries over whole texts, and loops over their tokens."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def tokens(self, text):
        a = [(i, bytes(self.letter[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        """[(A ids, B ids)] and links (a, b) of each kind."""
        a, b = self.tokens(text)
        groups, links, i, j, at_a, at_b = [], {"ends": [], "overlaps": [], "groups": []}, 0, 0, 0, 0
        own_a, own_b = [], []
        while i < len(a) and j < len(b):
            end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            links["overlaps"].append((a[i][0], b[j][0]))
            if end_a == end_b:
                own_a.append(a[i][0])
                own_b.append(b[j][0])
                groups.append((own_a, own_b))
                links["ends"].append((a[i][0], b[j][0]))
                links["groups"] += [(x, y) for x in own_a for y in own_b]
                own_a, own_b, i, j, at_a, at_b = [], [], i + 1, j + 1, end_a, end_b
            elif end_a < end_b:
                own_a.append(a[i][0])
                i, at_a = i + 1, end_a
            else:
                own_b.append(b[j][0])
                j, at_b = j + 1, end_b
        return len(a), len(b), groups, links

    def rows(self, docs, kind):
        found = [(d, self.groups(t or "")) for d, t in docs]
        count = Counter(x for _, g in found for x in g[3][kind])
        most = {}
        for (_, b), n in count.items():
            most[b] = max(n, most.get(b, 0))
        out = []
        for d, (n_a, n_b, groups, links) in found:
            own = links[kind]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((-1 if d is None else d, n_a, n_b, len(groups), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), text))
        return sorted(out)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def as_rows(df, last="groups"):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last))) for r in df.collect())


@pytest.mark.parametrize("kind", alignment.KINDS)
def test_odd_texts(spark, plain, kind):
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, block string, pairs int").repartition(3)
    assert as_rows(alignment.align(docs, *PATHS, kind=kind)) == plain.rows(rows, kind)


def test_query(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in common.documents(spark, SF).select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain.rows(docs, "ends")]
    assert as_rows(alignment.op13_alignment(spark, SF), "groups_sha256") == sorted(want)


def test_products_and_overlaps_of_long_tokens():
    """One group of two and three tokens, then one of one and one."""
    a, b = np.array([2, 6, 9]), np.array([1, 3, 6, 9])
    assert [list(x) for x in alignment.linked(a, b, "ends")] == [[1, 2], [2, 3]]
    assert [list(x) for x in alignment.linked(a, b, "overlaps")] == [[0, 0, 1, 1, 2], [0, 1, 1, 2, 3]]
    assert [list(x) for x in alignment.linked(a, b, "groups")] == [[0, 0, 0, 1, 1, 1, 2], [0, 1, 2, 0, 1, 2, 3]]


def test_no_piece_starts_before_a_blank():
    """What cutting texts at blanks rests on."""
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    assert not [p for p in map(b.id_to_piece, range(b.vocab_size())) if "▁" in p.lstrip("▁")]


def test_forgetful_workers_give_the_same(spark, plain):
    own = alignment.Pair(*PATHS, "ends")
    chunks = [" a", " b", " the", " a", "  "]
    at = own.numbers(chunks)
    first = own.counts[at].tolist()
    own._forget()
    at = own.numbers(chunks)
    assert own.counts[at].tolist() == first and at[0] == at[3]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    with pytest.raises(ValueError):
        alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS, kind="other")
