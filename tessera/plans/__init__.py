"""Named queries, each with the SQL that must give the same rows (none where SQL cannot)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, requests, rerank, tokens, vectors

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (rerank, vectors, tokens, requests, evaluation)


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    found = {name: pair for m in _MODULES for name, pair in m.QUERIES.items()}
    return {n: q for n, (q, _) in found.items()}, {n: s for n, (_, s) in found.items() if s}
