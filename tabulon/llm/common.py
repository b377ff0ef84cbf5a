"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define words: space and \x09-\x0D.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where a session on one machine names none, as in tests, a fresh local folder
    is set as the checkpoint folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only a new read of the files.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A lambda variable holds the value, so that neither the optimizer's merging
    of projections nor a loop inside ``body`` computes it again.
    """
    return F.transform(F.array(value), body)[0]


def blank_words(text: Column) -> Column:
    """The maximal pieces without ASCII white space; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(word: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is used where it is the same."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, LOWER)
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame, keys: list[str | Column], name: str, number: str) -> DataFrame:
    """``df`` with the place of each row in the order of ``keys``, from 0, and the
    partition that holds it, ``_part``.

    Rows are dealt by range, sorted and written once; a place is a row's place
    in its partition plus the rows of the partitions before, one number a
    partition.  No task holds more than a partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # the partition above 33 bits of a row's place in it
    rows = materialise(ordered.withColumn("_id", at), name)
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    sizes = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    before, total = [], 0
    for part, size in sizes:
        before.append((part, total))
        total += size
    shifts = spark.createDataFrame(before, "_part bigint, _before bigint")
    placed = rows.join(F.broadcast(shifts), "_part")  # a row a partition
    return placed.withColumn(number, F.col("_place") + F.col("_before")).drop("_place", "_before")
