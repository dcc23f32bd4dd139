"""The queries of the reference's operators: name -> query, with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own or another name."""

    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return put
