"""How a query is declared: a function of a table reader, and SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Table = Callable[[str], DataFrame]


def query(sql: str | None = None, name: str | None = None):
    """Registers ``f(table)`` under its name; ``table`` reads a table of the session's folder by name."""

    def declare(f: Callable[[Table], DataFrame]) -> Callable[[Table], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name or f.__name__] = run
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return declare
