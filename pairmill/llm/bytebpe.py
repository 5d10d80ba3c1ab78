"""Byte-level BPE encoding and decoding through a global shuffle of distinct words (operator 11).

Blocks of documents are cut into pre-tokens by the vocabulary's pattern; a
block holds each distinct one once, and the pre-tokens' places as numbers of
these. The distinct words of all blocks are shuffled by a hash of the word.
Where a word's copies meet it is encoded once, and its ids go back to each
block that holds it, where every document is put together by place. Decoding
looks ids up in the table of the tokens' bytes, which is as large as the
vocabulary.

A block's words travel as one body for each shard of words, so a frequent
word moves once for each block and not once for each place; no more than a
block, or the words of a shard, are in a task's memory. Shards are as many as
shuffle partitions. A block is shuffled once, and both its words and its places
are taken from that exchange; so docs should be rows that come in the same
order if a task is run again, as those of a table do.

A null or empty text has no ids. Repeated ids and rows are documents of their
own; further columns of docs are left out. An id that the vocabulary lacks, or
a null one, makes a decoded row null; null ids decode to null. An empty table
gives no rows. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common
from pairmill.llm.chunks import BLOCK_BYTES, ByteRuns, chunked, flags, packed, spread, unpacked
from pairmill.llm.shingles import _power
from pairmill.llm.wordtok import _GAPS

VOCABULARY = "byte_bpe_50k.tiktoken"
_PATTERN = regex.compile(public_tokenizers.PATTERN)
_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """A file of ranks: its encoder, its tokens' bytes and its ids' decimals."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        by_id = {i: token for token, i in ranks.items()}
        self.size = max(by_id) + 1
        self.known = np.array([i in by_id for i in range(self.size)])
        self.bytes = ByteRuns([by_id.get(i, b"") for i in range(self.size)])
        self.decimals = ByteRuns([b"%d " % i for i in range(self.size)])


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, where each one starts and the last ends)."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)), ends - ends[0]


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pre-tokens, number of each one in turn, offsets of each text's).

    Chunks that start with their blank are split in one pass over all of them
    side by side, as none of them ends in white space; others alone.
    """
    chunks, codes, offs = chunked(texts, False, _PATTERN.findall)
    blank = flags(pc.match_substring_regex(chunks, rf"^ [^{_GAPS}]")) & ~flags(pc.match_substring_regex(chunks, rf"[{_GAPS}]$"))
    led, alone = chunks.filter(pa.array(blank)), chunks.filter(pa.array(~blank)).to_numpy(zero_copy_only=False).tolist()
    parts = [_PATTERN.findall(_raw(led)[0].tobytes().decode()), *map(_PATTERN.findall, alone)]
    words = pa.array([w for part in parts for w in part], pa.large_string())
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))[: len(parts[0])]
    stops = np.concatenate([np.searchsorted(ends, np.cumsum(pc.binary_length(led).to_numpy(zero_copy_only=False))) + 1, len(parts[0]) + np.cumsum([len(x) for x in parts[1:]], dtype=np.int64)]).astype(np.int64)
    place = np.empty(len(chunks), np.int64)
    place[np.concatenate([np.flatnonzero(blank), np.flatnonzero(~blank)])] = np.arange(len(chunks))
    codes = place[codes]
    kinds, start = words.dictionary_encode(), np.concatenate([[0], stops[:-1]])
    at, upto = spread(start[codes], (stops - start)[codes])
    return kinds.dictionary, kinds.indices.to_numpy(zero_copy_only=False)[at], upto[offs]


def _shards(words: pa.Array, shards: int) -> np.ndarray:
    """Shard of each word, by a polynomial of its bytes."""
    raw, ends = _raw(words)
    base = 0x9E3779B97F4A7C15
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(base, len(raw)), out=sums[1:])
    value = (sums[ends[1:]] - sums[ends[:-1]]) * _power(pow(base, -1, 2**64), len(raw) + 1)[ends[:-1]]
    return ((value ^ value >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % shards


_BLOCK = "doc_ids array<long>, sizes array<long>, places binary, shards array<int>, words array<binary>"


def _blocks(docs: DataFrame, shards: int) -> DataFrame:
    """A row for each block: its documents with their numbers of pre-tokens, the places, and the words of each shard.

    Words are numbered shard by shard, so ids that come back in this order
    need no numbers.
    """

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for b in common.steps(batch, limit=BLOCK_BYTES):
                words, codes, offs = pretokens(b["text"])
                shard = _shards(words, shards)
                order = pc.sort_indices(pa.table({"shard": shard, "word": words}), sort_keys=[("shard", "ascending"), ("word", "ascending")]).to_numpy()
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                raw, ends = _raw(words.take(pa.array(order)))
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist() + [len(order)]
                bodies = [pack.compress(np.array([z - a], "<i8").tobytes() + np.diff(ends[a : z + 1]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + raw[ends[a] : ends[z]].tobytes()) for a, z in zip(cuts, cuts[1:])]
                yield pa.record_batch(
                    {
                        "doc_ids": pa.array([b["doc_id"].to_pylist()], pa.list_(pa.int64())),
                        "sizes": pa.array([np.diff(offs)], pa.list_(pa.int64())),
                        "places": pa.array([packed(number[codes])], pa.binary()),
                        "shards": pa.array([shard[order][cuts[:-1]].astype(np.int32)], pa.list_(pa.int32())),
                        "words": pa.array([bodies], pa.list_(pa.binary())),
                    }
                )

    return common.texts(docs).mapInArrow(run, _BLOCK)


def _encoder(path: str):
    """Ids of each body of words of a shard; each distinct word of a shard is encoded once, as rows come shard by shard."""

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode, unpack = vocabulary(path).encode, zstandard.ZstdDecompressor()
        at, known, runs = None, {}, []
        for shards, bodies in batches:
            out = []
            for shard, body in zip(shards.to_pylist(), bodies.to_pylist()):
                if shard != at:
                    at, known, runs = shard, {}, []
                raw = unpack.decompress(body)
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n).T).view("<u4")[:, 0]
                ids: list[int] = []
                count, a = [], 8 + 4 * n
                for size in sizes.tolist():
                    word = raw[a : a + size]
                    a += size
                    i = known.get(word)
                    if i is None:
                        i = known[word] = len(runs)
                        runs.append(encode(word.decode()))
                    ids += runs[i]
                    count.append(len(runs[i]))
                out.append(packed(np.array(count, np.int64), np.array(ids, np.int64)))
            yield pa.array(out, pa.binary())

    return encoded


def _documents(batches):
    """(doc_ids, ids of all the block's documents in turn, offsets of each one's) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            size, ids = [], []
            for part in sorted(row["encoded"].to_pylist()[0] or [], key=lambda x: x["shard"]):
                for to, x in zip((size, ids), unpacked(part["ids"])):
                    to.append(x)
            size, ids = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (size, ids))
            places = unpacked(row["places"][0].as_py())[0]
            at, upto = spread((np.cumsum(size) - size)[places], size[places])
            offs = np.concatenate([[0], np.cumsum(row["sizes"].to_pylist()[0], dtype=np.int64)])
            yield row["doc_ids"].to_pylist()[0], ids[at], upto[offs]
            common.give_back()


#: The blocks are named by a function that isn't deterministic, so Spark shuffles them once and reads that exchange twice.
_ASSEMBLED = """
WITH b AS (SELECT /*+ REPARTITION({n}, block) */ * FROM (SELECT monotonically_increasing_id() AS block, * FROM {blocks})),
w AS (SELECT /*+ REPARTITION({n}, shard) */ block, w.shards AS shard, w.words AS body FROM b LATERAL VIEW explode(arrays_zip(shards, words)) AS w),
e AS (SELECT block, shard, pm_encode_words__(shard, body) AS ids FROM (SELECT * FROM w SORT BY shard)),
g AS (SELECT block, collect_list(struct(shard, ids)) AS encoded FROM e GROUP BY block)
SELECT b.doc_ids, b.sizes, b.places, g.encoded FROM b LEFT JOIN g ON b.block = g.block
"""


def _assembled(docs: DataFrame, path: str) -> DataFrame:
    """The blocks with the ids of their words: at most a block's distinct words meet in one list."""
    spark = docs.sparkSession
    n = common.partitions(spark)
    spark.udf.register("pm_encode_words__", _encoder(path))
    return spark.sql(_ASSEMBLED, n=n, blocks=_blocks(docs, n))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each document."""

    def run(batches):
        for doc_ids, ids, offs in _documents(batches):
            yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))})

    return _assembled(docs, path).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of each row of rows (doc_id, ids)."""

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            out = []
            for ids in batch["ids"].to_pylist():
                sound = ids is not None and all(i is not None and 0 <= i < own.size and own.known[i] for i in ids)
                out.append(own.bytes.joined(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes() if sound else None)
            yield pa.record_batch({"doc_id": batch["doc_id"], "bytes": pa.array(out, pa.binary())})

    common.small_batches(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


#: Ids whose decimals and bytes one step gathers.
STEP_IDS = 1_000_000


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimals joined by a blank) and decoded_sha256 (of the bytes that the ids decode to)."""

    def sha(table: ByteRuns, ids: np.ndarray, drop: int) -> str:
        """Of the ids' strings in turn, without the last drop bytes."""
        found = hashlib.sha256()
        for a in range(0, len(ids), STEP_IDS):
            part = ids[a : a + STEP_IDS]
            flat = table.joined(part, np.array([0, len(part)]))[0]
            found.update(flat[: len(flat) - drop * (a + STEP_IDS >= len(ids))])
        return found.hexdigest()

    def run(batches):
        own = vocabulary(path)
        for doc_ids, ids, offs in _documents(batches):
            each = list(zip(offs[:-1].tolist(), offs[1:].tolist()))
            yield pa.record_batch(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "n_tokens": pa.array(np.diff(offs)),
                    "ids_sha256": pa.array([sha(own.decimals, ids[a:z], 1) for a, z in each], pa.string()),
                    "decoded_sha256": pa.array([sha(own.bytes, ids[a:z], 0) for a, z in each], pa.string()),
                }
            )

    return _assembled(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
