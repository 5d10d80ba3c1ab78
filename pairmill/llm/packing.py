"""Packing into sequences by order-preserving dynamic programming (operator 5).

Documents stay in ascending order of ids. A sequence is a window of at most
``length`` tokens between two cuts; it is padded to ``length`` unless its
number of tokens is a power of two. A cut costs nothing between documents,
SENTENCE behind a sentence's last token and ANYWHERE elsewhere; a window costs
its padding. The cheapest series of cuts is found left to right: the padded
windows take the least of cost + position over a sliding window, which a
monotone queue keeps, and the others are tried by length.

A null text is encoded as empty: its document is the end id. Equal ids are
ordered by a hash of the text, missing ids come first. Repeated rows are
packed each. One programme runs over a whole range of documents (a partition),
however the range is dealt into batches; cuts are given out as soon as every
way that is still open shares them, so memory doesn't grow with the range.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common
from pairmill.llm.wordtok import Encoder, encoder

LENGTH = 4096
STEP_CHARS = 2_000_000
SENTENCE, ANYWHERE = 8, 32
#: Tokens without a sentence's end after which cuts anywhere are tried, and so often.
_GAP = 256


def sentence_ends(enc: Encoder) -> np.ndarray:
    """For each id, whether its piece can end a sentence."""
    ends = np.zeros(enc.tok.get_vocab_size() + 1, bool)
    for piece, i in enc.tok.get_vocab().items():
        bare = piece.removesuffix("</w>")
        if bare and set(bare) <= set(".!?\"')") and set(bare) & set(".!?"):
            ends[i] = True
    return ends


def candidates(doc_ends: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions from 1 to the last document's end where a cut is tried, ascending; their costs)."""
    whole = np.unique(doc_ends)
    soft = np.setdiff1d(marks, whole, assume_unique=True)
    near = np.concatenate([[0], np.union1d(whole, soft)])
    hard = [np.arange(near[i] + _GAP, near[i + 1], _GAP) for i in np.flatnonzero(np.diff(near) > _GAP)]
    hard = np.concatenate([np.zeros(0, np.int64), *hard])
    at = np.concatenate([whole, soft, hard]).astype(np.int64)
    cost = np.repeat([0, SENTENCE, ANYWHERE], [len(whole), len(soft), len(hard)])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def with_tail(at: np.ndarray, cost: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Also the positions from which the last window, up to total, needs no padding."""
    tail = total - 2 ** np.arange(length.bit_length() - 1)
    tail = np.setdiff1d(tail[tail > 0], at)
    at, cost = np.concatenate([at, tail]), np.concatenate([cost, np.full(len(tail), ANYWHERE)])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


class Cutter:
    """The programme over positions that arrive in order.

    Costs and ways back are kept for the positions whose best series of cuts
    isn't settled: ``settled`` gives the cuts that all ways share and forgets
    what lies before the last of them. So neither memory nor the cuts depend
    on how the positions were dealt into calls.
    """

    def __init__(self, length: int):
        self.length = length
        self.powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]  # a whole window is in the queue
        self.pos, self.best, self.back = [0], [0], [0]
        self.queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, number, position)
        self.base = 0  # number of pos[0]

    def feed(self, at: np.ndarray, cost: np.ndarray) -> None:
        """Positions after all before, and their costs."""
        if not len(at):
            return
        base, length, queue, pos, best, back = self.base, self.length, self.queue, self.pos, self.best, self.back
        known = np.concatenate([np.array(pos, np.int64), at])
        first = len(pos)
        exact: dict[int, list[int]] = {}
        for q in self.powers:  # windows that need no padding
            want = at - q
            k = np.minimum(np.searchsorted(known, want), len(known) - 1)
            for j in np.flatnonzero(known[k] == want).tolist():
                exact.setdefault(j, []).append(int(k[j]))
        none: tuple = ()
        for j, (p, extra) in enumerate(zip(at.tolist(), cost.tolist())):
            while queue[0][2] < p - length:
                queue.popleft()
            low, i, _ = queue[0]
            low += length - p
            for k in exact.get(j, none):
                if best[k] < low:
                    low, i = best[k], base + k
            low += extra
            pos.append(p)
            best.append(low)
            back.append(i)
            value = low + p
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, base + first + j, p))

    def settled(self, end: bool = False) -> list[int]:
        """Cuts, ascending, that no later position changes and that weren't given before; with end, all to the last position."""
        pos, back, base = self.pos, self.back, self.base
        last = len(pos) - 1
        if end:
            at = last
        else:  # the last cut that the ways of all positions share from which a window can still start
            front = {i for i in range(last, -1, -1) if pos[i] >= pos[last] - self.length}
            while len(front) > 1:
                top = max(front)
                front.remove(top)
                front.add(max(0, back[top] - base))
            (at,) = front
        cuts, i = [], at
        while i > 0:
            cuts.append(pos[i])
            i = max(0, back[i] - base)
        if not end and at:
            shift = self.best[at]
            self.base += at
            self.pos, self.back = pos[at:], back[at:]
            self.best = [x - shift for x in self.best[at:]]
            self.queue = deque((v - shift, i, p) for v, i, p in self.queue)
        return cuts[::-1]


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Positions of the cheapest series of cuts, 0 and the end among them; at begins with 0."""
    cutter = Cutter(length)
    cutter.feed(at[1:], cost[1:])
    return [0, *cutter.settled(end=True)]


class Packer:
    """Packs documents that arrive in order; gives record batches of pieces."""

    def __init__(self, enc: Encoder, end_id: int, length: int, sequence: int):
        self.enc, self.end_id, self.length, self.sequence = enc, end_id, length, sequence
        self.sentence = sentence_ends(enc)
        self.cutter = Cutter(length)
        none = np.zeros(0, np.int64)
        self.held = none, none  # candidates not yet fed
        self.total, self.cut = 0, 0  # tokens so far; the last cut given out
        self.flat = np.zeros(0, "<u4")  # tokens from there
        self.ids: list[int | None] = []  # documents that end behind it
        self.first, self.end = none, none

    def add(self, doc_ids: list, texts: list[str]):
        ids, offs = self.enc(texts)
        n = len(offs) - 1
        doc_end = offs[1:] + np.arange(1, n + 1)
        flat = np.empty(len(ids) + n, "<u4")
        own = np.ones(len(flat), bool)
        own[doc_end - 1] = False
        flat[own], flat[~own] = ids, self.end_id
        marks = np.flatnonzero(own & self.sentence[np.where(own, flat, 0)]) + 1
        at, cost = candidates(doc_end, marks)
        at, cost = np.concatenate([self.held[0], at + self.total]), np.concatenate([self.held[1], cost])
        self.ids += doc_ids
        self.first = np.concatenate([self.first, np.concatenate([[0], doc_end[:-1]]) + self.total])
        self.end = np.concatenate([self.end, doc_end + self.total])
        self.flat = np.concatenate([self.flat, flat])
        self.total += len(flat)
        sure = int(np.searchsorted(at, self.total - self.length, side="right"))
        self.held = at[sure:], cost[sure:]
        self.cutter.feed(at[:sure], cost[:sure])
        return self._given(self.cutter.settled())

    def finish(self):
        self.cutter.feed(*with_tail(*self.held, self.total, self.length))
        return self._given(self.cutter.settled(end=True))

    def _given(self, cuts: list[int]):
        if not cuts:
            return
        cut = np.array(cuts, np.int64)
        last = cuts[-1]
        piece_end = np.union1d(cut, self.end[self.end <= last])
        piece = np.concatenate([[self.cut], piece_end[:-1]])
        doc = np.searchsorted(self.end, piece, side="right")
        seq = np.searchsorted(cut, piece, side="right")
        begin = np.concatenate([[self.cut], cut[:-1]])[seq]
        raw = self.flat[: last - self.cut].tobytes()
        yield pa.record_batch(
            {
                "doc_id": pa.array([self.ids[d] for d in doc.tolist()], pa.int64()),
                "start": pa.array(piece - self.first[doc]),
                "length": pa.array(piece_end - piece),
                "doc_tokens": pa.array((self.end - self.first)[doc]),
                "sequence_id": pa.array(self.sequence + seq),
                "offset": pa.array(piece - begin),
                "ids": pa.array([raw[4 * i : 4 * j] for i, j in zip((piece - self.cut).tolist(), (piece_end - self.cut).tolist())], pa.binary()),
            }
        )
        self.sequence += len(cuts)
        done = int(np.searchsorted(self.end, last, side="right"))
        self.flat, self.cut = self.flat[last - self.cut :], last
        self.ids, self.first, self.end = self.ids[done:], self.first[done:], self.end[done:]


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Pieces of documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        packer = Packer(encoder(tokenizer, lowered=True), end_id, length, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for b in common.steps(batch, limit=STEP_CHARS):
                yield from packer.add(b["doc_id"].to_pylist(), b["text"].to_pylist())
        if packer.total:
            yield from packer.finish()

    return common.in_order(docs).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
