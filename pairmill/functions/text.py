"""Column expressions over strings, URLs and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_words(text: Column) -> Column:
    """Number of parts between single blanks; neighbouring blanks make empty parts that count."""
    return F.size(F.split(text, " ")).cast("long")


def space_words(text: Column) -> Column:
    """Number of words between runs of white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def filled(*cols: Column) -> Column:
    """Whether no column is null or empty; blanks alone are content."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & (c != "")
    return out


def url_remainder(url: Column) -> Column:
    """Path, query and fragment."""
    return F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*", "")


def without_extension(text: Column) -> Column:
    """All before the last dot; empty without one."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.[^.]*$", "")).otherwise(F.when(text.isNotNull(), F.lit("")))


def canonical_url(url: Column) -> Column:
    """https, host in lower case without www. and default port, sorted non-blank parameters, no fragment, no last slash."""
    url = F.trim(url)
    url = F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    params = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    params = F.array_join(F.array_sort(F.filter(params, lambda p: p.rlike(r"^[^=]+=.+"))), "&")
    return F.concat(F.lit("https://"), host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit("")))


def labelled_lines(fields: dict[str, Column]) -> Column:
    """Lines "label: value" of the fields that have one."""
    return F.concat_ws("\n", *[F.when(filled(c), F.concat(F.lit(f"{k}: "), c)) for k, c in fields.items()])


def merged_json(json: Column, more: dict[str, Column]) -> Column:
    """A flat JSON object of strings with further keys; later ones win."""
    old = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    keys = F.array(*map(F.lit, more))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(keys, k))
    new = F.map_from_arrays(keys, F.array(*[c.cast("string") for c in more.values()]))
    return F.to_json(F.map_concat(kept, new))


def only_keys(json: Column, keys: list[str], keep: bool = True) -> Column:
    """A flat JSON object's entries with (or without) the keys."""
    listed = F.array(*map(F.lit, keys))
    inside = (lambda k, v: F.array_contains(listed, k)) if keep else (lambda k, v: ~F.array_contains(listed, k))
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), inside))


def pretend_list(text: Column) -> Column:
    """A list written with single quotes as an array; never evaluated."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")


def question_pairs(text: Column) -> Column:
    """Array of (question, context) found in generated text of numbered blocks."""
    pattern = r"(?s)Question:\s*(.*?)\s*Context:\s*(.*?)\s*(?=Question:|\z)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("question"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("context"))


def bucket(key: Column, salt: str = "") -> Column:
    """A number from 0 to 2**32-1 by MD5 of the key: the same in any engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
