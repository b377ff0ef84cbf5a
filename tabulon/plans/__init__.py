"""Queries over the given tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """``t.orders`` reads a table of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(tables)`` under ``name`` with its DuckDB SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rnd(x: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def load() -> None:
    """Import the modules that register queries; needs an active session for
    none of them: expressions are built when a query runs."""
    import importlib

    for name in ("scalar", "columns", "sources", "joins", "summary", "windows", "rows", "estimate", "panel", "charts", "text"):
        importlib.import_module(f"{__name__}.q_{name}")
