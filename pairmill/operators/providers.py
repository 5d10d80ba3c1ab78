"""Outside services behind one interface, with local stand-ins that give the same answer each time."""

from __future__ import annotations

import asyncio
import hashlib
import re
from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    """Answers a batch of texts; a worker makes one and keeps it."""

    schema: str

    async def answer(self, text: str) -> dict: ...


class HashEmbedder:
    """Signed hashing of words into a unit vector."""

    schema = "embedding array<float>"

    def __init__(self, dim: int = 64):
        self.dim = dim

    async def answer(self, text: str) -> dict:
        v = [0.0] * self.dim
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        return {"embedding": [x / n for x in v]}


class WordCounter:
    """Words and marks as a stand-in for tokens."""

    schema = "tokens long"

    async def answer(self, text: str) -> dict:
        return {"tokens": len(re.findall(r"\w+|[^\w\s]", text))}


class LengthJudge:
    """A quality label by length."""

    schema = "quality string"

    async def answer(self, text: str) -> dict:
        n = len(text.split())
        return {"quality": "high" if n >= 100 else "medium" if n >= 20 else "low"}


class SentenceAsker:
    """A question and its context for each of the first sentences."""

    schema = "questions array<string>, context array<string>"

    def __init__(self, most: int = 3):
        self.most = most

    async def answer(self, text: str) -> dict:
        found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()][: self.most]
        return {"questions": [f"What about {s.split()[0]}?" for s in found], "context": found}


def enrich(df: DataFrame, key: str, text: str, provider: Provider, concurrency: int = 16, on_error: str | None = None) -> DataFrame:
    """key, the provider's columns and status of each row.

    Calls of a partition run side by side up to concurrency; a call that fails
    gives nulls and its error's name as status, and harms no other row.
    """
    names = [c.strip().split()[0] for c in provider.schema.split(", ")]

    async def all_of(texts: Iterable[str]) -> list[dict]:
        gate = asyncio.Semaphore(concurrency)

        async def one(t):
            async with gate:
                try:
                    return dict(await provider.answer(t)) | {"status": "ok"}
                except Exception as e:  # a failed call is a result of its own
                    return {"status": on_error or type(e).__name__}

        return await asyncio.gather(*map(one, texts))

    def run(batches):
        for pdf in batches:
            got = asyncio.run(all_of(["" if t is None else t for t in pdf[text]]))
            out = pd.DataFrame({c: [g.get(c) for g in got] for c in [*names, "status"]}, dtype=object)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {provider.schema}, status string")


def pending(todo: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows that aren't in the results yet."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")
