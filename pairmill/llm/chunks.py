"""Texts cut into chunks at blanks, each distinct chunk looked at once.

A chunk starts with the blank before it and ends before the next one, where
the character on either side of a blank is no white space. There every pattern
and vocabulary at hand starts a new piece whatever stands around it. Texts
with white space beside a blank or at an end aren't cut here; the caller says
what their chunks are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from pairmill.llm.wordtok import _BESIDE
from pairmill.llm.wordtok import _spread as spread

#: Bytes of text whose chunks or words are numbered together.
BLOCK_BYTES = 8_000_000


def flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def chunked(texts: pa.Array, lead: bool, odd_chunks: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct chunks, number of each chunk in turn, offsets of each text's chunks).

    lead: the first chunk gets a blank before it too. odd_chunks gives those of
    texts that aren't cut at blanks, empty ones included.
    """
    column = texts.cast(pa.large_string())
    odd = flags(pc.or_(pc.match_substring_regex(column, _BESIDE), pc.equal(column, "")))
    split = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("x", pa.large_string()), column), " ")
    offs = split.offsets.to_numpy().astype(np.int64)
    offs = offs - offs[0]
    plain = split.flatten()
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, pa.scalar("", pa.large_string()))
    if not lead and len(plain):
        first = np.zeros(len(plain), bool)
        first[offs[:-1]] = True
        led = pc.if_else(pa.array(first), plain, led)
    start, size = offs[:-1].copy(), np.diff(offs)
    more: list[str] = []
    for i, text in zip(np.flatnonzero(odd).tolist(), column.filter(pa.array(odd)).to_pylist()):
        own = odd_chunks(text)
        start[i], size[i] = len(plain) + len(more), len(own)
        more += own
    if more:
        led = pa.concat_arrays([led, pa.array(more, pa.large_string())])
    kinds = led.dictionary_encode()
    at, upto = spread(start, size)
    codes = kinds.indices.to_numpy(zero_copy_only=False)[at]
    if odd.any():  # the stand-ins of odd texts go
        used, codes = np.unique(codes, return_inverse=True)
        return kinds.dictionary.take(pa.array(used)), codes, upto
    return kinds.dictionary, codes, upto


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers below 2^32 as one compressed body, bytes of equal weight side by side."""
    sizes = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays))


def unpacked(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 + 8 * n
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4")[:, 0])
        at += 4 * size
    return out


class ByteRuns:
    """Byte strings by number, whose concatenations are gathered at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)])
        self.sizes = np.diff(self.ends)

    def joined(self, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the strings with these numbers in turn, offsets of those of each run of numbers)."""
        at, upto = spread(self.ends[codes], self.sizes[codes])
        return self.flat[at], upto[offs]
