"""The library on streams: operators without state take a streaming frame as it
is; ``each_batch`` applies any other operator to the batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def check_stateless(df: DataFrame) -> DataFrame:
    """``df``, or an error where it is a stream that needs state."""
    plan = df._jdf.queryExecution().analyzed().toString()
    if df.isStreaming and any(k in plan for k in ("Aggregate [", "Window [", "Sort [", "Deduplicate")):
        raise ValueError("the stream needs state: use each_batch or a watermark")
    return df


def each_batch(df: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, kind: str = "parquet"):
    """A running query that appends ``operator`` of every batch to ``path``."""

    def run(batch: DataFrame, _: int) -> None:
        operator(batch).write.mode("append").format(kind).save(path)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
