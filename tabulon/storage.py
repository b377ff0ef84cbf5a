"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame


def shared_dir(sc: SparkContext) -> str:
    """spark.checkpoint.dir, or a fresh local folder where the session runs on one machine."""
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="spark-")


def stable(df: DataFrame) -> DataFrame:
    """``df`` written once to spark.checkpoint.dir, so that what is read later
    is the same rows in the same partitions even after executors are lost.

    A session on one machine without that setting, as in tests, gets a fresh local
    folder; on a cluster a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(sc))
    return df.checkpoint()
