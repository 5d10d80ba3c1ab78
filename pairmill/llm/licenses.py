"""License scans by a positional index of rare words (operator 8); DataFrame functions only.

Templates are whole licences, and passages of them, with a label and a
mandatory key phrase each. A template is posted under those words of its key phrase with the highest
inverse document frequency in the scanned corpus, with their positions. A file
that holds no template's rarest word is done; of the others the words are
looked up in that index, a template's postings are intersected by the start
that each found position implies, and at the starts that remain the whole key
phrase is verified. A place counts if ENOUGH of the template's words stand
where it has them; the score is the share at the best place. All of this
happens within the row, so nothing but counts of words is shuffled and no file
is cut.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered. A null
or empty text has no words and no places: null first and last word, empty
labels, score 0. Repeated rows and ids give a row each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import common
from pairmill.llm.licence_texts import TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lowered


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # start and end of the mandatory phrase
    base: bool = False


def _template(label: str, passage: str, key: str | None = None, base: bool = False) -> Template:
    own, phrase = tuple(passage.split()), tuple((key or passage).split())
    at = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
    return Template(label, own, (at, at + len(phrase)), base)


#: Phrases and passages of well-known licences, as their texts have them; of passages also the key phrase.
BASE = (
    _template("cc-by", "cc by", base=True),
    _template("gpl", "general public license", base=True),
    _template("reserved", "all rights reserved", base=True),
)
MORE = (
    _template("apache", "licensed under the apache license version 2 0"),
    _template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "to deal in the software without restriction"),
    _template("mit", "released under the mit license"),
    _template("bsd", "redistribution and use in source and binary forms"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "with or without modification are permitted"),
    _template("mpl", "mozilla public license"),
    _template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "source code form is subject to the terms"),
    _template("isc", "permission to use copy modify and or distribute this software"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    _template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "without any express or implied warranty"),
    _template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it"),
    _template("lgpl", "gnu lesser general public license"),
    _template("agpl", "gnu affero general public license"),
    _template("gpl", "gnu general public license"),
    _template("epl", "eclipse public license"),
    _template("cc-by-sa", "creative commons attribution sharealike"),
    _template("cc-by", "creative commons attribution"),
    _template("cc0", "no copyright reserved"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)
#: Whole licences and notices, taken apart as scanned texts are.
_parts = lambda text: " ".join(w for w in re.split(_BREAK, text.lower()) if w)
WHOLE = tuple(_template(label, _parts(text), _parts(phrase)) for label, phrase, text in TEXTS)
TEMPLATES = BASE + MORE + WHOLE
#: Words of a template that the index posts, at most; percentage of its words that have to stand in their places.
POSTED, ENOUGH = 3, 80


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _BREAK), lambda w: w != "")


def _any_of(found: list[str]) -> Column:
    """Whether the text holds one of the words, perhaps at the start of longer ones; one pass without taking it apart."""
    return F.col("text").rlike(f"(?i)(?<!{_WORD[:-1]})(?:{'|'.join(found)})")  # ASCII letters alone lose their case


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Documents that hold each word of the key phrases, among those that hold a phrase's longest word; one aggregated row for each word comes back."""
    vocabulary = sorted({w for t in templates for w in t.words[slice(*t.key)]})
    longest = sorted({max(t.words[slice(*t.key)], key=lambda w: (len(w), w)) for t in templates})
    found = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.where(_any_of(longest)).select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def posted(templates: tuple[Template, ...], df: dict[str, int]) -> dict[Template, list[int]]:
    """For each template, the positions of its key phrase's rarest words, rarest first: ties to the longer word, then the earlier."""
    return {t: sorted(range(*t.key), key=lambda i: (df.get(t.words[i], 0), -len(t.words[i]), i))[:POSTED] for t in templates}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and the places (label, start, size, matched, base) of every template in each text."""
    index = posted(templates, document_frequencies(docs, templates))
    rare = sorted({t.words[i] for t, at in index.items() for i in at})
    first = sorted({t.words[at[0]] for t, at in index.items()})
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words.alias("n_words"), F.when(_any_of(first), words(F.col("text"))).alias("w"))
    # the look-up: positions of the indexed words, taken apart only where there are some
    looked = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(rare))
    rows = rows.withColumn("hits", F.when(F.arrays_overlap("w", F.array(*map(F.lit, rare))), looked))

    def implied(word: str, at: int) -> Column:
        """The starts that a word's hits imply for a template that has it there."""
        return F.transform(F.filter("hits", lambda x: x["word"] == word), lambda x: x["at"] - F.lit(at))

    def places(t: Template) -> Column:
        starts = None
        for i in index[t]:
            own = implied(t.words[i], i)
            starts = own if starts is None else F.array_intersect(starts, own)
        a, z = t.key
        phrase = F.array(*map(F.lit, t.words[a:z]))
        sure = F.filter(F.array_distinct(starts), lambda s: (s >= 0) & (F.slice(F.col("w"), F.greatest(s, F.lit(0)) + a + 1, z - a) == phrase))
        if (a, z) == (0, len(t.words)):
            matched = lambda s: F.lit(len(t.words))
        else:
            whole = F.array(*map(F.lit, t.words))
            matched = lambda s: F.size(F.filter(F.zip_with(F.slice(F.col("w"), s + 1, len(t.words)), whole, lambda x, y: x == y), lambda x: x))
        found = F.transform(sure, lambda s: F.struct(F.lit(t.label).alias("label"), s.cast("long").alias("start"), F.lit(len(t.words)).alias("size"), matched(s).alias("matched"), F.lit(t.base).alias("base")))
        return F.filter(found, lambda x: x["matched"] * 100 >= x["size"] * ENOUGH)

    none = F.array().cast("array<struct<label:string,start:bigint,size:int,matched:int,base:boolean>>")
    found = F.when(F.col("hits").isNotNull(), F.flatten(F.array(*[places(t) for t in templates]))).otherwise(none)
    return rows.select("doc_id", "n_words", found.alias("places"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(common.documents(spark, sf_dir))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    best = F.array_max(F.transform("places", lambda p: p["matched"] / p["size"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.round(best, 6), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """DuckDB SQL for the base columns and the method's."""
    lists = ", ".join(f"({n}, '{t.label}', {list(t.words)!r}, {t.key[0]}, {t.key[1]}, {str(t.base).lower()})" for n, t in enumerate(TEMPLATES))
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), t(n, label, ws, a, z, base) AS (VALUES {lists}),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM w),
tw AS (SELECT n, label, ws, a, z, base, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS off FROM t),
p AS (
  SELECT tok.doc_id, tw.n, tw.label, tw.base, tok.pos - tw.off AS beg, count(DISTINCT tw.off) / len(tw.ws) AS share
  FROM tok JOIN tw USING (word) GROUP BY tok.doc_id, tw.n, tw.label, tw.base, tw.ws, tw.a, tw.z, tok.pos - tw.off
  HAVING count(DISTINCT tw.off) * 100 >= len(tw.ws) * {ENOUGH} AND count(DISTINCT tw.off) FILTER (tw.off >= tw.a AND tw.off < tw.z) = tw.z - tw.a AND beg >= 0
), agg AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(beg) FILTER (base) AS first_word, max(beg) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM p GROUP BY 1
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(share, 6), 0.0)::DOUBLE AS score
FROM w LEFT JOIN agg USING (doc_id)
"""


ORACLE_SQL = _oracle()
