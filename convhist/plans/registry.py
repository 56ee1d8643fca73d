"""Registry of the runnable queries and, where SQL can say it, of their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, dir) -> DataFrame`` with the SQL that must agree with it."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        QUERIES[name] = function
        if sql is not None:
            CHECK_SQL[name] = sql
        return function

    return register
