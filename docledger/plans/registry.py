"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docledger.plans.sql import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named domain tables."""
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_tables(list(tables), sql)
        return function

    return register
