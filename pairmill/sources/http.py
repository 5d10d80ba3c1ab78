"""Rows enriched over HTTP: threads in each task, retries with growing pauses, connections kept open.

A task asks for a batch of rows with a few threads; each thread keeps its
connection to a host. An answer of 429 or 5xx and a broken connection are
tried again after a pause that doubles (or as long as the server asks for);
``per_second`` bounds a task's calls. Every row gets one answer:

* status 200 to 299: the body;
* 404: no body, status 404 (what was asked for is missing);
* anything else, or no answer in all tries: no body and no status (a failure).

Answers in XML become columns by ``related``: a missing or empty answer has an
empty list, a failure null, so a later run can ask for failures alone.
"""

from __future__ import annotations

import http.client
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers that a later try may mend.
AGAIN = {408, 425, 429, 500, 502, 503, 504}
LONGEST_PAUSE = 30.0


class Client:
    """Requests of one task."""

    def __init__(self, tries: int, pause: float, timeout: float, per_second: float | None):
        self.tries, self.pause, self.timeout = tries, pause, timeout
        self.gap, self.next_, self.lock = (1 / per_second if per_second else 0.0), 0.0, threading.Lock()
        self.own = threading.local()

    def _wait(self) -> None:
        """Until this call's turn."""
        if self.gap:
            with self.lock:
                turn = max(time.monotonic(), self.next_)
                self.next_ = turn + self.gap
            time.sleep(max(0.0, turn - time.monotonic()))

    def _asked(self, url: str) -> tuple[int, bytes, str | None]:
        parts = urlsplit(url)
        kept = self.own.__dict__.setdefault("connections", {})
        place = (parts.scheme, parts.netloc)
        if place not in kept:
            kept[place] = (http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection)(parts.netloc, timeout=self.timeout)
        try:
            kept[place].request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
            answer = kept[place].getresponse()
            return answer.status, answer.read(), answer.getheader("Retry-After")
        except Exception:
            kept.pop(place).close()
            raise

    def get(self, url: str | None) -> tuple[int | None, str | None, int]:
        """(status, body, tries)."""
        if not url:
            return None, None, 0
        for n in range(1, self.tries + 1):
            self._wait()
            wait = None
            try:
                status, body, wait = self._asked(url)
            except (OSError, http.client.HTTPException, ValueError):
                status = None
            if status is not None and 200 <= status < 300:
                return status, body.decode("utf-8", "replace"), n
            if status == 404:
                return 404, None, n
            if status is not None and status not in AGAIN:
                return None, None, n
            if n < self.tries:
                asked = float(wait) if wait and wait.isdigit() else self.pause * 2 ** (n - 1)
                time.sleep(min(asked, LONGEST_PAUSE))
        return None, None, self.tries


def fetched(df: DataFrame, url: str, threads: int = 10, tries: int = 3, pause: float = 0.5, timeout: float = 30.0, per_second: float | None = None) -> DataFrame:
    """df with http_status, body and tries of each row's url."""
    names = df.columns

    def run(batches):
        client = Client(tries, pause, timeout, per_second)
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(client.get, [u if isinstance(u, str) else None for u in pdf[url]]))
                out = pdf.reindex(columns=names)
                out["http_status"] = pd.array([s for s, _, _ in got], dtype="Int32")
                out["body"] = pd.Series([b for _, b, _ in got], dtype=object, index=out.index)
                out["tries"] = [n for _, _, n in got]
                yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, http_status int, body string, tries int")


def related(answers: DataFrame, row: str, field: str, name: str = "related") -> DataFrame:
    """answers with name: the texts of ``field`` in every ``row`` element of the XML body, in order.

    Missing (404) and bodies without such rows have none; failures and bodies
    that aren't XML have null.
    """
    found = F.transform(F.coalesce(F.from_xml("body", f"{row} array<struct<{field}: string>>", {"mode": "PERMISSIVE"})[row], F.array()), lambda r: r[field])
    sound = F.try_to_binary(F.col("body"), F.lit("utf-8")).isNotNull() & F.col("body").rlike(r"(?s)^\s*<.*>\s*$")
    none = F.array().cast("array<string>")
    return answers.withColumn(name, F.when(F.col("http_status") == 404, none).when(F.col("http_status").isNotNull() & sound, F.filter(found, lambda x: x.isNotNull())))
