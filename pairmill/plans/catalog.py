"""All queries of the core library, gathered from the modules that register them."""

from __future__ import annotations

from pairmill.plans import benchmarks, curate, dealt, evalset, evaluation, functions, loaders, pairing, registry, roundtrips, search, streams, tolerant  # noqa: F401  registration


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
