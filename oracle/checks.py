"""Registry of checked queries: a Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int = 6) -> Column:
    from barloom.schema import finite

    column = F.col(value) if isinstance(value, str) else value
    return F.round(finite(column.cast("double")), digits)


def seconds(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.unix_seconds(column.cast("timestamp"))
