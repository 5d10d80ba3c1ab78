"""Two tokenizers' tokens of the same text aligned by byte (operator 13).

The token ends of both sides, united, cut the bytes into elementary intervals;
each has one owner on either side, the first token that ends at or behind the
interval's end, so each interval is one overlap of two tokens. Ends that both
sides share close groups. Links are pairs of tokens that end together (the
contract of the query), overlap, or lie in one group (each group's product).

Where a blank follows a character and precedes another one, tokens of both
vocabularies start anew, so a text is cut there into chunks, a worker aligns
each distinct chunk once, and a text's alignment is that of its chunks in
turn. What is counted over the corpus are pairs of ids: blocks of documents
send the distinct pairs that they hold with their numbers; the totals and each
B id's highest one are joined back to the pairs of each block, and there to its
documents. A pair is one row of a block, however often it stands there.

Texts that are null, empty, or whose joined A or B bytes differ from a blank
and the text have no tokens. Repeated ids and rows are documents of their own;
further columns of docs are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairmill.llm import common
from pairmill.llm.chunks import ByteRuns, chunked, packed, spread, unpacked
from pairmill.llm.wordtok import _byte_letters, _Table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct chunks that a worker remembers before it starts anew; new ones that it aligns at once.
MEMORY, STEP = 200_000, 4_000
#: Bytes of text of a block.
BLOCK_BYTES = 4_000_000
KINDS = ("ends", "overlaps", "groups")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner among A, owner among B, whether the interval closes a group) of each elementary interval.

    Ends ascend and no token is empty, so an interval has one owner a side.
    """
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def linked(ends_a: np.ndarray, ends_b: np.ndarray, kind: str = "ends") -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) of all links of one kind of KINDS, in order of A, then B."""
    a, b, closed = intervals(ends_a, ends_b)
    if kind == "overlaps":
        return a, b
    if kind == "ends":
        return a[closed], b[closed]
    to_a, to_b = a[closed] + 1, b[closed] + 1  # the groups' stops
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    left, group = np.arange(n_a.sum()), np.repeat(np.arange(len(n_a)), n_a)
    right, upto = spread((to_b - n_b)[group], n_b[group])
    return np.repeat(left, np.diff(upto)), right


class Pair:
    """Both tokenizers, their tokens' bytes, and the chunks that a worker has aligned."""

    def __init__(self, path_a: str, path_b: str, kind: str):
        self.a, self.kind = Tokenizer.from_file(path_a), kind
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter = {c: b for b, c in _byte_letters().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = ByteRuns([bytes(letter[c] for c in p) if all(c in letter for c in p) else p.encode() for p in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = ByteRuns([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.blank = self.b.piece_to_id("▁")
        # an id's decimals with what follows it: another id of its side, or the end of the side
        n = max(len(names), len(pieces))
        self.n, self.written = n, ByteRuns([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(n)])
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)
        self.strings, self.pairs = _Table(np.uint8), _Table(np.int64)

    def _learn(self, text: str, sizes: np.ndarray) -> bool:
        """Align chunks of these numbers of bytes, side by side in text, and remember them; whether both sides' bytes are the text's.

        The chunks' ends are shared, so no group or link reaches over them.
        """
        raw, none = np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64)
        ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        ids_b = np.array(self.b.encode(text[1:]) if text != " " else [self.blank], np.int64)  # B adds the first blank itself
        for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)):
            if not np.array_equal(table.joined(ids, none)[0], raw):
                return False
        ends_a, ends_b, ends = np.cumsum(self.bytes_a.sizes[ids_a]), np.cumsum(self.bytes_b.sizes[ids_b]), np.cumsum(sizes)
        a, b, closed = intervals(ends_a, ends_b)
        stop_a, stop_b = a[closed] + 1, b[closed] + 1
        link_a, link_b = linked(ends_a, ends_b, self.kind)
        # where each chunk's tokens, groups and links stop
        upto_a, upto_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        to_group, to_link = np.searchsorted(stop_a, upto_a) + 1, np.searchsorted(link_a, upto_a)
        if not (np.array_equal(ends_a[upto_a - 1], ends) and np.array_equal(ends_b[upto_b - 1], ends)):
            return False  # not cut where both sides start anew
        # the groups written out: A's ids of a group, then B's
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        upto = np.cumsum(n_a + n_b)
        mark = np.zeros(len(ids_a) + len(ids_b), np.int64)
        mark[upto - n_b - 1], mark[upto - 1] = 1, 2
        ids = np.empty(len(mark), np.int64)
        of_b = np.repeat(np.tile([False, True], len(n_a)), np.stack([n_a, n_b], axis=1).ravel())
        ids[~of_b], ids[of_b] = ids_a, ids_b
        flat, stops = self.written.joined(mark * self.n + ids, np.concatenate([none, upto[to_group - 1]]))
        self.strings.add(flat, stops[1:])
        self.pairs.add(ids_a[link_a] << 32 | ids_b[link_b], to_link)
        self.counts = np.concatenate([self.counts, np.stack([np.diff(x, prepend=0) for x in (upto_a, upto_b, to_group, to_link)], axis=1)])
        return True

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The chunks' numbers among those known; new ones are aligned, some thousands at once.

        Chunks of a blank and a word go side by side, others, and those beside
        one whose bytes differ, alone.
        """
        if len(self.counts) > MEMORY:
            self._forget()
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        plain = [c for c in new if len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        alone = [c for c in new if not (len(c) > 1 and not c[1].isspace() and not c[-1].isspace())]
        for part in [*(plain[a : a + STEP] for a in range(0, len(plain), STEP)), *([c] for c in alone)]:
            for some in [part] if self._learn("".join(part), np.array([len(c.encode()) for c in part])) else [[c] for c in part]:
                if some is not part and not self._learn(some[0], np.array([len(some[0].encode())])):
                    self._none()
                self.number.update(zip(some, range(len(self.number), len(self.number) + len(some))))
        return np.array([self.number[c] for c in chunks], np.int64)

    def _none(self) -> None:
        """Remember a chunk whose bytes differ."""
        self.strings.add(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.pairs.add(np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.counts = np.concatenate([self.counts, [[-1, 0, 0, 0]]])


_pairs: dict[tuple[str, str, str], Pair] = {}


def pair(path_a: str, path_b: str, kind: str) -> Pair:
    """One for each worker, files and kind."""
    if (path_a, path_b, kind) not in _pairs:
        _pairs[path_a, path_b, kind] = Pair(path_a, path_b, kind)
    return _pairs[path_a, path_b, kind]


_BLOCK = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, links binary, pairs array<long>, counts array<long>"


def _blocks(docs: DataFrame, path_a: str, path_b: str, kind: str, digest: bool) -> DataFrame:
    """A row for each block: its documents with their numbers and groups, its distinct pairs with their counts, and which pairs a document links how often."""

    def run(batches):
        own, name = pair(path_a, path_b, kind), TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in common.steps(batch, limit=BLOCK_BYTES):
                chunks, codes, offs = chunked(b["text"], True, lambda t: [f" {t}"] if t else [])
                at = own.numbers(chunks.to_numpy(zero_copy_only=False).tolist())
                counts = own.counts[at]
                n_docs = len(offs) - 1
                doc = np.repeat(np.arange(n_docs), np.diff(offs))
                sound = np.bincount(doc[counts[codes, 0] < 0], minlength=n_docs) == 0
                sums = [np.bincount(doc, weights=counts[codes, k], minlength=n_docs).astype(np.int64) * sound for k in range(4)]
                text, upto = own.strings.runs(at[codes])
                groups = []
                for d in range(n_docs):
                    whole = text[upto[offs[d]] : upto[offs[d + 1]]][:-1].tobytes() if sound[d] else b""
                    groups.append((hashlib.sha256(whole).hexdigest() if whole else "") if digest else whole.decode())
                # a document's distinct chunks with their numbers, and each chunk's pairs
                some = sound[doc]
                key, times = np.unique(doc[some] * len(at) + codes[some], return_counts=True)
                links, upto = own.pairs.runs(at)
                size = np.diff(upto)
                pairs, which = np.unique(links, return_inverse=True)
                of, upto = spread((np.cumsum(size) - size)[key % max(1, len(at))], size[key % max(1, len(at))])
                total = np.bincount(which[of], weights=np.repeat(times, np.diff(upto)), minlength=len(pairs)).astype(np.int64)
                used = total > 0  # pairs of unsound texts alone are none
                body = packed(np.bincount(key // max(1, len(at)), minlength=n_docs), key % max(1, len(at)), times, size, which, np.flatnonzero(used))
                lists = {"n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "pairs": pairs[used], "counts": total[used]}
                yield pa.record_batch(
                    {
                        "block": pa.array([name], pa.int64()),
                        "doc_ids": pa.array([b["doc_id"].to_pylist()], pa.list_(pa.int64())),
                        **{k: pa.array([v], pa.list_(pa.int64())) for k, v in lists.items() if k[0] == "n"},
                        "groups": pa.array([groups], pa.list_(pa.string())),
                        "links": pa.array([body], pa.binary()),
                        **{k: pa.array([v], pa.list_(pa.int64())) for k, v in lists.items() if k[0] != "n"},
                    }
                )
                name += 1

    return common.texts(docs).mapInArrow(run, _BLOCK)


def _scored(batches):
    """The documents of each block with the sums over their links of what came back for the pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            n_of, chunk, times, size, which, used = (x.astype(np.int64) for x in unpacked(row["links"][0].as_py()))
            found = row["totals"].flatten().flatten()  # pair, total, best
            values = np.zeros((2, int(used.max()) + 1 if len(used) else 0), np.int64)
            if len(used):
                pairs, total, best = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found)
                order = np.argsort(pairs)
                values[:, used] = np.stack([total[order], best[order]])
            at = np.concatenate([[0], np.cumsum(size)])
            doc = np.repeat(np.arange(len(n_of)), n_of)
            sums = []
            for value in values:
                upto = np.concatenate([[0], np.cumsum(np.concatenate([value, np.zeros(max(0, int(which.max(initial=-1)) + 1 - len(value)), np.int64)])[which])])
                by_chunk = upto[at[1:]] - upto[at[:-1]]
                own = np.concatenate([[0], np.cumsum(by_chunk[chunk] * times)])  # whole numbers, no rounding
                ends = np.concatenate([[0], np.cumsum(n_of)])
                sums.append(own[ends[1:]] - own[ends[:-1]])
            assert len(doc) == len(chunk)
            columns = {k: row[k].flatten() for k in ("n_a", "n_b", "n_groups", "n_links")}
            yield pa.record_batch({"doc_id": row["doc_ids"].flatten(), **columns, "n_best": pa.array(sums[1]), "count_sum": pa.array(sums[0]), "groups": row["groups"].flatten()})
            common.give_back()


def align(docs: DataFrame, path_a: str, path_b: str, kind: str = "ends", digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``, or its sha256) of each document."""
    if kind not in KINDS:
        raise ValueError(f"kind has to be one of {KINDS}")
    blocks = common.written(_blocks(docs, path_a, path_b, kind, digest), "align-blocks")
    each = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = common.written(each.groupBy("pair").agg(F.sum("n").alias("total")), "align-totals")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id")
    most = totals.groupBy(b_id).agg(F.max("total").alias("most"))
    known = totals.select("pair", "total", b_id).join(most, "b_id").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    back = each.select("block", "pair").join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "total", "best")).alias("totals"))  # a block's distinct pairs
    rows = blocks.drop("pairs", "counts").join(back, "block", "left").drop("block")
    rows = rows.select("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "totals")
    return rows.mapInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align(common.documents(spark, sf_dir), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE), digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")
