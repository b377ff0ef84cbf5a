"""Records of JSON arrays, whatever the number of tasks that read a file.

A text scan that ends a row at each closing brace is cut at any byte, as every
text file is.  Whether a brace stands inside a string, and how deep it lies, follow
from quotes and braces before it: each block of a file sums its own for both states
it may begin in, and running sums over the blocks, of which there is one a split,
tell which of the two holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TYPE = re.compile(r"`(?:[^`]|``)*`|\b(?:OBJECT(?=<)|DECIMAL\(\d+, ?\d+\)|VOID|VARIANT)(?![:\w])")


def _count(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark)))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, q, o0, o1): text up to each closing brace, in order of
    ``at``; quotes, and opening braces outside strings if it begins outside (o0) or
    inside (o1) of one.  A brace cannot be escaped, so no escape crosses a border."""
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    outside = lambda t: F.regexp_replace(t, r'"[^"]*("|$)', "")
    return raw.select("file", "block", "at", "value", _count(plain, '"').alias("q"), _count(outside(plain), "{").alias("o0"), _count(outside(F.concat(F.lit('"'), plain)), "{").alias("o1"))


def _joined_up(parts: Column) -> Column:
    """The texts of (place, text) pairs in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda p: p["text"]), "")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of each object at the top of a file or of its array.

    Files may hold an array, one object, or objects after each other; empty files and
    arrays have no record, and scalars among the records are left out.  Rows come in
    no order; a file that is cut off gives its last, incomplete record as it is.
    """
    order = Window.partitionBy("file", "block").orderBy("at")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = _pieces(spark, path).withColumn("turn", F.coalesce(F.sum("q").over(before), F.lit(0)))

    def moves(state: int) -> Column:
        inside = (F.col("turn") + state) % 2 == 1
        shut = (F.col("turn") + state + F.col("q")) % 2 == 0
        return F.when(inside, F.col("o1")).otherwise(F.col("o0")) - shut.cast("int")

    rows = rows.withColumns({"m0": moves(0), "m1": moves(1)})
    rows = rows.withColumns({"d0": F.sum("m0").over(upto), "d1": F.sum("m1").over(upto)})

    # one row a block: the state and depth it begins with, and the block that its first record began in
    blocks = rows.groupBy("file", "block").agg(F.sum("q").alias("bq"), *(F.sum(f"m{s}").alias(f"b{s}") for s in (0, 1)), *(F.min(f"d{s}").alias(f"low{s}") for s in (0, 1)))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("state", F.coalesce(F.sum("bq").over(earlier), F.lit(0)) % 2)
    pick = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    blocks = blocks.withColumns({"own": pick("b"), "low": pick("low")}).withColumn("base", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    begins = (F.col("base") == 0) | (F.col("base") + F.col("low") <= 0)
    blocks = blocks.withColumn("owner", F.last(F.when(begins, F.col("block")), ignorenulls=True).over(earlier)).select("file", "block", "state", "base", "owner")

    rows = rows.join(blocks, ["file", "block"]).withColumn("depth", F.col("base") + pick("d"))
    rows = rows.withColumn("end", ((F.col("depth") == 0) & ((F.col("turn") + F.col("state") + F.col("q")) % 2 == 0)).cast("int"))
    rows = rows.withColumns({"no": F.coalesce(F.sum("end").over(before), F.lit(0)), "ends": F.sum("end").over(Window.partitionBy("file", "block"))})
    head = (F.col("no") == 0) & (F.col("base") > 0)
    rows = rows.filter("depth >= 0").select(  # what follows the last record has depth -1
        "file", "block", "at", F.concat("value", F.lit("}")).alias("text"), F.when(head | (F.col("no") == F.col("ends")), -1).otherwise(F.col("no")).alias("no"), F.when(head, F.col("owner")).otherwise(F.col("block")).alias("start")
    )
    runs = rows.groupBy("file", "block", "start", "no").agg(_joined_up(F.struct("at", "text")).alias("text"))
    # at most two runs a block reach over its borders
    across = runs.filter("no < 0").groupBy("file", "start").agg(_joined_up(F.struct("block", "text")).alias("text"))
    out = runs.filter("no >= 0").select("text").unionByName(across.select("text"))
    return out.select(F.regexp_replace("text", r"^[^{]*", "").alias("record"))


def schema_of(records: DataFrame) -> str:
    """The type that all records fit, by one aggregate: whole numbers are bigint, others
    double, and fields of mixed or no type string."""
    found = records.select(F.schema_of_variant_agg(F.try_parse_json("record"))).first()[0]
    if not found.startswith("OBJECT<") or found == "OBJECT<>":
        raise ValueError("no records with fields")
    new = {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}
    return _TYPE.sub(lambda m: m[0] if m[0].startswith("`") else new.get(m[0], "DOUBLE"), found)
