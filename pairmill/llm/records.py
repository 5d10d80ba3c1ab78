"""Token ids in length-delimited binary record files with an offset index (operator 4).

A record is: length of the payload (8 bytes, little-endian), masked CRC-32C of
those 8 bytes, the payload, masked CRC-32C of the payload, and a line feed
that Spark's text writer adds. A payload is the id of the document (8 bytes),
whether there is one (1), bytes of each token id (1: 2 or 4), the token ids.
A file ends behind the record with which it passes FILE_BYTES, so a reader that
takes a whole file holds that many bytes and one record, however long texts are.
Files hold ascending ids, and files in order of their part numbers go on. The
index, parquet, has for each record its file, offset, length, id, number of
tokens and checksum of the tokens, so that a shuffled read can fetch it alone.

A null text is encoded as empty: its record holds the end id. Documents with
equal ids are ordered by a hash of the text, those without an id come first. Repeated rows
give a record each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmill.llm import common
from pairmill.llm.wordtok import encoder

STEP_CHARS = 8_000_000
#: Bytes of a file, but for its last record: a file, or one record, fits into a task's memory.
FILE_BYTES = 32 << 20
#: Bytes that are checksummed at once.
SUM_BYTES = 1 << 18
_HEAD = "<qBB"
_CHUNK = 512
#: CRC-32C's reversed polynomial and the mask's summand.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8
_tables: list[np.ndarray] = []


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Eight tables for eight bytes a step, and four that pass a CRC over a chunk of zeros."""
    if not _tables:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
        eight = [one]
        for _ in range(7):
            eight.append((eight[-1] >> 8) ^ one[eight[-1] & 0xFF])
        over = np.array([np.uint32(b << 8 * k) for k in range(4) for b in range(256)], dtype=np.uint32)
        for _ in range(_CHUNK):
            over = (over >> 8) ^ one[over & 0xFF]
        _tables.extend([np.stack(eight), over.reshape(4, 256)])
    return _tables[0], _tables[1]


def crc32c(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32C of each data[start:start+size], sizes 4 at least; runs over all at once."""
    if not len(start):
        return np.zeros(0, np.uint32)
    t, over = _crc_tables()
    chunks = -(-size // _CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    lanes = np.zeros((int(chunks.sum()), _CHUNK), np.uint8)
    flat = lanes.reshape(-1)
    to = (first + chunks) * _CHUNK - size  # the first chunk is filled with zeros before its bytes, which change nothing
    upto = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(upto[-1])
    flat[np.repeat(to - upto[:-1], size) + step] = data[np.repeat(start - upto[:-1], size) + step]
    for k in range(4):
        flat[to + k] ^= 0xFF
    crc = np.zeros(len(lanes), np.uint32)
    for at in range(0, _CHUNK, 8):
        low = crc ^ np.ascontiguousarray(lanes[:, at : at + 4]).view("<u4")[:, 0]
        crc = t[7][low & 0xFF] ^ t[6][low >> 8 & 0xFF] ^ t[5][low >> 16 & 0xFF] ^ t[4][low >> 24]
        for k in range(4):
            crc ^= t[3 - k][lanes[:, at + 4 + k]]
    total = crc[first]
    for k in range(1, int(chunks.max())):
        on = np.flatnonzero(chunks > k)
        had = total[on]
        total[on] = over[0][had & 0xFF] ^ over[1][had >> 8 & 0xFF] ^ over[2][had >> 16 & 0xFF] ^ over[3][had >> 24] ^ crc[first[on] + k]
    return ~total


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15 | crc << 17) + np.uint32(_MASK)).astype(np.uint32)


def _sums(payloads: list[bytes]) -> np.ndarray:
    """Masked checksums, of about SUM_BYTES at once."""
    size = np.array([len(p) for p in payloads], np.int64)
    part = (np.cumsum(size) - size) // SUM_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(payloads)]
    out = []
    for a, z in zip(cuts[:-1], cuts[1:]):
        own = size[a:z]
        out.append(crc32c(np.frombuffer(b"".join(payloads[a:z]), np.uint8), np.cumsum(own) - own, own))
    return masked(np.concatenate(out))


def framed(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its lengths and checksums, without the line feed."""
    if not payloads:
        return []
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = _sums(lengths), _sums(payloads)
    return [n + struct.pack("<I", h) + p + struct.pack("<I", b) for n, h, p, b in zip(lengths, heads.tolist(), payloads, bodies.tolist())]


def parsed(data: bytes) -> tuple[list[int], list[bytes]]:
    """(offsets, payloads) of a file's records; raises where a checksum differs."""
    at, offs, lengths, payloads, heads, bodies = 0, [], [], [], [], []
    while at < len(data):
        (n, head) = struct.unpack_from("<QI", data, at)
        if at + 17 + n > len(data):
            raise ValueError(f"a record at {at} is cut off")
        offs.append(at)
        lengths.append(data[at : at + 8])
        heads.append(head)
        payloads.append(data[at + 12 : at + 12 + n])
        bodies.append(struct.unpack_from("<I", data, at + 12 + n)[0])
        at += 17 + n
    if payloads and not ((_sums(lengths) == heads).all() and (_sums(payloads) == bodies).all()):
        raise ValueError("a record's checksum differs")
    return offs, payloads


def tokens_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, known, width = struct.unpack_from(_HEAD, payload)
    return (doc if known else None), np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_HEAD))


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> None:
    """Encode every text, append end_id, write record files under path in ascending order of ids.

    A row is a whole file: its records with the line feeds between them.
    """

    def run(batches):
        encode = encoder(tokenizer)
        held, size = [], 0
        for batch in batches:
            for b in common.steps(batch, limit=STEP_CHARS):
                ids, offs = encode(b["text"].to_pylist())
                wide = ids.dtype.itemsize
                if end_id >= 1 << 8 * wide:
                    raise ValueError("the end id needs more bytes than the vocabulary's ids")
                raw, end = ids.astype(f"<u{wide}").tobytes(), int(end_id).to_bytes(wide, "little")
                cut = (offs * wide).tolist()
                out = framed([struct.pack(_HEAD, d or 0, d is not None, wide) + raw[cut[i] : cut[i + 1]] + end for i, d in enumerate(b["doc_id"].to_pylist())])
                for record in out:
                    held.append(record)
                    size += len(record) + 1
                    if size >= file_bytes:
                        yield pa.record_batch({"file": pa.array([b"\n".join(held)], pa.binary())})
                        held, size = [], 0
        if held:
            yield pa.record_batch({"file": pa.array([b"\n".join(held)], pa.binary())})

    common.in_order(docs).mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files under path, checksums verified.

    file, part (number of the file in order), offset, length, doc_id, before
    (tokens before it in its file), n_tokens, ids_crc32.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch["file"].to_pylist(), batch["content"]):
                offs, payloads = parsed(data.as_buffer().to_pybytes())
                found = [tokens_of(p) for p in payloads]
                n = np.array([len(t) for _, t in found], np.int64)
                yield pa.record_batch(
                    {
                        "file": pa.array([name] * len(offs), pa.string()),
                        "offset": pa.array(offs, pa.int64()),
                        "length": pa.array([len(p) + 16 for p in payloads], pa.int64()),
                        "doc_id": pa.array([d for d, _ in found], pa.int64()),
                        "before": pa.array(np.cumsum(n) - n, pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(t.astype("<u4")) for _, t in found], pa.int64()),
                    }
                )

    # an empty table may leave no file: no records then
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, offset long, length long, doc_id long, before long, n_tokens long, ids_crc32 long")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: tokens of all records before, over all files in order."""
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    more = F.regexp_extract("file", r"-c(\d+)\.", 1)
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))  # a row for each file
    order = Window.orderBy(part, F.when(more == "", "0").otherwise(more).cast("long")).rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("first"))
    return index.join(first, "file").withColumn("start", F.col("first") + F.col("before")).drop("first")


def write_with_index(docs: DataFrame, path: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write record files and their offset index; return the index as read back."""
    spark = docs.sparkSession
    write_records(docs, f"{path}/records", tokenizer, end_id, file_bytes)
    index = scan_records(spark, f"{path}/records")
    index.write.parquet(f"{path}/index")
    return with_starts(spark.read.schema(index.schema).parquet(f"{path}/index"))


def fetch(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """doc_id and tokens of the records in index (any rows of it): each file is read once, which is at most FILE_BYTES and a record."""

    def run(batches):
        for batch in batches:
            for data, at in zip(batch["content"], batch["at"].to_pylist()):
                view = data.as_buffer().to_pybytes()
                found = []
                for off, size in at:
                    _, payloads = parsed(view[off : off + size + 1])
                    found += [tokens_of(p) for p in payloads]
                yield pa.record_batch({"doc_id": pa.array([d for d, _ in found], pa.int64()), "tokens": pa.array([t.astype(np.int64) for _, t in found], pa.list_(pa.int64()))})

    wanted = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # the records of one file
    wanted = wanted.select("file", F.transform("at", lambda x: F.array(x["offset"], x["length"])).alias("at"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(wanted, "file").select("content", "at").mapInArrow(run, "doc_id long, tokens array<long>")


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = write_with_index(common.documents(spark, sf_dir), common.scratch_path(spark, "op4"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")
