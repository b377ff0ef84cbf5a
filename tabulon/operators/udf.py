"""Python over a dataset, a group, or a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def python(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on batches of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def python_by(df: DataFrame, by: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on each group; a group has to fit into a task."""
    return df.groupBy(*by).applyInPandas(fn, schema)


def score_text(df: DataFrame, col: str, new: str, load: Callable[[], Callable[[list[str]], list]], kind: str = "double", batch: int = 256) -> DataFrame:
    """A column from a model that ``load`` makes once a task."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out: list = []
            for k in range(0, len(s), batch):
                out += list(model(s.iloc[k : k + batch].tolist()))
            yield pd.Series(out, index=s.index)

    return df.withColumn(new, run(F.col(col)))
