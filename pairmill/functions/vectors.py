"""Column expressions over vectors: similarities, sign bits, Hamming scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def manhattan(a: Column, b: Column) -> Column:
    """Negative L1 distance."""
    return -_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """Negative L2 distance."""
    return -F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


#: Pluggable scores, by name.
SCORES = {"cosine": cosine, "dot": dot, "manhattan": manhattan, "euclidean": euclidean}


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / n)


def truncated(v: Column, dim: int) -> Column:
    return normalised(F.slice(v, 1, dim))


def signs(v: Column) -> Column:
    """-1, 0 or 1."""
    return F.transform(doubles(v), lambda x: F.signum(x).cast("int"))


def padded(v: Column, to: int = 8, fill: float = 0.0) -> Column:
    """v with fill up to a length that to divides."""
    return F.concat(doubles(v), F.array_repeat(F.lit(fill), F.pmod(-F.size(v), F.lit(to)).cast("int")))


def packed_bytes(v: Column, at_zero: bool = True) -> Column:
    """Eight sign bits in each signed byte, the first on top; a component of 0 counts as at_zero."""
    bit = (lambda x: (x >= 0).cast("int")) if at_zero else (lambda x: (x > 0).cast("int"))
    eight = lambda i: F.aggregate(F.slice(v, i * 8 + 1, 8), F.lit(0), lambda a, x: a * 2 + bit(x))
    byte = F.transform(F.sequence(F.lit(0), (F.size(v) / 8).cast("int") - 1), eight)
    return F.transform(byte, lambda b: F.when(b > 127, b - 256).otherwise(b))


def unpacked(bytes_: Column) -> Column:
    """The bits of packed bytes."""
    return F.flatten(F.transform(bytes_, lambda b: F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.pmod(F.floor(F.pmod(b, F.lit(256)) / F.pow(F.lit(2), i)), F.lit(2)).cast("int"))))


def hamming(a: Column, b: Column) -> Column:
    """Bits of two packed vectors that agree."""
    return (F.size(a) * 8 - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(F.pmod(x, F.lit(256)).bitwiseXOR(F.pmod(y, F.lit(256))))), F.lit(0), lambda s, x: s + x)).cast("double")


def agreement(a: Column, b: Column) -> Column:
    """Mean of (ab + 1) / 2 over vectors of signs."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x * y + 1) / 2)) / F.size(a)


def confidence(logits: Column) -> Column:
    """Greatest softmax probability."""
    top = F.array_max(doubles(logits))
    return 1 / _sum(F.transform(doubles(logits), lambda x: F.exp(x - top)))
