"""Word and shingle hashes of many texts at once, in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. A
word's 64-bit hash is a polynomial of random byte weights, taken from prefix
sums over the whole buffer, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(0x5EED)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_WEIGHT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT[65:91] = _WEIGHT[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and each text's start and end in them; one separator follows each text."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words)."""
    raw, ends = _buffer(texts)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~_SEPARATOR[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_WEIGHT[raw] * _power(_BASE, n), out=sums[1:])
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = (sums[stop] - sums[start]) * _power(_INVERSE, n)[start]
    return mix(words ^ (stop - start).astype(np.uint64)), np.searchsorted(start, ends).astype(np.int64)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, repeats kept, offsets of each text's shingles).

    A text of 1 to width-1 words has one shingle, its whole sequence; a text
    without words has none.
    """
    words, offs = word_hashes(texts)
    n = np.diff(offs)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    total = len(words)
    if total == 0:
        return np.zeros(0, np.uint64), out
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    acc = np.zeros(total, np.uint64)
    for k in range(width):
        acc += padded[k : k + total] * _ORDER[k]
    keep = np.ones(total, bool)
    for k in range(1, width):
        at = offs[1:] - k
        keep[at[(n >= width) & (at >= 0)]] = False
    for i in np.flatnonzero((n > 0) & (n < width)):
        a, b = offs[i], offs[i + 1]
        keep[a + 1 : b] = False
        acc[a] = (words[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    return mix(acc[keep]), out
