"""Registered queries over the fixed tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add ``fn(spark, sf_dir)`` as query ``name``, with the SQL that gives the same rows."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def oracle_sql_of(name: str) -> str:
    """The SQL of a query registered before."""
    return _SQL[name]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plans() -> None:
    """Import the modules that register queries."""
    from .plans import corpus, extra, hooks, lifecycle, metadata, more, queries, search, sources  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search of the benchmark's phrases over all chunks."""
    return queries()["r02_keyword_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _plans()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _plans()
    return _SQL
