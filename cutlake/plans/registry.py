"""Name → (Spark query, SQL check) registry filled by the family modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutlake.plans.views import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its optional SQL check."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    import importlib

    for family in FAMILIES:
        importlib.import_module(f"cutlake.plans.{family}")


FAMILIES = ["q_timeline", "q_footage", "q_music", "q_intervals", "q_scoring", "q_takes", "q_sources", "q_streams"]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, path, fn=fn: fn(Tables(spark, path))) for n, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
