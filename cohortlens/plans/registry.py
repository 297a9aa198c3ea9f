"""Query registry: id -> (Spark plan over ``Tables``, DuckDB oracle SQL)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name`` with optional oracle SQL.

    Queries without SQL are the rows-only ones (ML fits, writers, Python-side
    similarity) and are checked against brute force in tests instead.
    """
    def deco(fn: Callable[..., DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
