"""Registry of queries, each with the SQL that says the same where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero, so that two engines print the same."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def one_row(spark: SparkSession, **values: object) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))
