"""Personal data: fixed rules and a trained character tagger (operator 6).

Base spans are the leftmost non-overlapping matches of a pattern for each
kind, those that fail a check of their digits dropped. A bidirectional LSTM
with CRF transitions adds spans of the same kinds where no base span is:
addresses and numbers in notations that the rules don't have. An added span
has to hold what its kind holds in any notation (a domain behind an at, four
numbers or eight groups, 14 to 19 digits that pass Luhn, 9 to 15 digits). So
none is without a digit or an at, and the tagger reads every text around each
of these, CONTEXT characters to either side, stretches that touch made one:
long ones in overlapping windows whose scores are put together before one
decision. Reading the stretches in between as well can add nothing but
context from further away, at twenty times the cost.

A null or empty text has no spans. Positions count code points, ends are
exclusive. Repeated rows and ids give a row each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common
from pairmill.llm.tagger import KINDS, Reader, classes, train

#: Characters that the tagger reads beside a digit or an at: as many as its training sentences hold.
CONTEXT = 32
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[A-Za-z0-9._%+-]+@")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ so that long runs of letters cost no more."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            end, at = max(end, at), text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _count(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), in order of start, then kind."""
    if not _TRIGGER.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _count(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_count(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


_AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)
_DOT = re.compile(r"[A-Za-z0-9-]\s?(?:\.|\[dot\]|\bdot\b)\s?[A-Za-z]{2}", re.IGNORECASE)


def _plausible(kind: int, found: str) -> bool:
    """Whether an added span holds what its kind holds in any notation."""
    digits = _count(found)
    if kind == 0:
        at = _AT.search(found)
        return bool(at and at.start() and _DOT.search(found, at.end()))
    if kind == 1:
        four = re.findall(r"[0-9]+", found)
        six = [x for x in found.split(":") if x]
        return (len(four) == 4 and found.count(".") == 3 and all(len(x) <= 3 and int(x) <= 255 for x in four)) or (len(six) == 8 and all(re.fullmatch("[0-9A-Fa-f]{1,4}", x) for x in six))
    return (14 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15


_NEEDED = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_INSIDE = (re.compile(r"\S.*\S", re.DOTALL), re.compile(r"[0-9A-Fa-f].*[0-9A-Fa-f]", re.DOTALL), re.compile(r"[0-9].*[0-9]", re.DOTALL), re.compile(r"[+(0-9].*[0-9]", re.DOTALL))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and ats."""
    out: list[list[int]] = []
    for m in _NEEDED.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def all_spans(reader: Reader, batch: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    where = [(i, a, b) for i, t in enumerate(batch) for a, b in regions(t)]
    base = [base_spans(t) for t in batch]
    more: list[list] = [[] for _ in batch]
    for (i, at, _), found in zip(where, reader.spans([classes(batch[i][a:b]) for i, a, b in where])):
        for kind, s, e in found:
            own = _INSIDE[kind].search(batch[i][at + s : at + e])
            if own and _plausible(kind, own[0]):
                s, e = at + s + own.start(), at + s + own.end()
                if not any(x < e and s < y for _, x, y in base[i]):
                    more[i].append((kind, s, e))
    return [(b, sorted(b + m, key=lambda s: (s[1], s[0]))) for b, m in zip(base, more)]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (kind, start, end) of each text."""
    weights = train()

    def column(rows):
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in row] for row in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    def run(batches):
        reader = Reader(weights)
        for batch in batches:
            for b in common.steps(batch):
                got = all_spans(reader, b["text"].to_pylist())
                yield pa.record_batch({"doc_id": b["doc_id"], "base": column(x for x, _ in got), "spans": column(x for _, x in got)})

    return common.texts(docs).mapInArrow(run, f"doc_id long, base {_SPAN}, spans {_SPAN}")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind that starts it."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced and n_chars, where there is one, counted anew; null texts stay null."""
    weights = train()
    common.small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        reader = Reader(weights)
        for batch in batches:
            for b in common.steps(batch):
                texts = b.column(at).to_pylist()
                got = all_spans(reader, [t or "" for t in texts])
                new = [None if t is None else redacted(t, s) if s else t for t, (_, s) in zip(texts, got)]
                yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(common.documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counted = [_kind_count(k) for k in KINDS]
    return rows.select("doc_id", *counted, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _kind_count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
