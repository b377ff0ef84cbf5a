"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import plans

    plans.load()
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import plans

    plans.load()
    return dict(plans.SQL)
