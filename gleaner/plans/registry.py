"""Named queries, each with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Inputs, with_views

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``."""
    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def _load() -> None:
    from . import (aggregate_queries, evidence_queries, facet_queries, location_queries,  # noqa: F401
                   quality_queries, source_queries, state_queries, text_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, folder, fn=fn: fn(Inputs(spark, folder))) for n, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: with_views(s) for n, s in _SQL.items()}
