"""Registry of the queries over the given tables and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from dialoglake.plans import context, corpus, curation, serving  # noqa: F401  register their queries

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _ORACLES
