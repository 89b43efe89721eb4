"""Query registry: each named query is a Spark plan builder ``(spark, sf_dir) ->
DataFrame`` plus, where SQL can express it, an independent DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder under ``name`` (with its oracle SQL, if any)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_base, queries_convergence, queries_models, queries_spatial, queries_misc, queries_text, queries_transitions, queries_validation  # noqa: F401
