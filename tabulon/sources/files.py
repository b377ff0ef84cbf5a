"""Reading and writing files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_arrays import json_records, schema_of

# option words that users type (fixed values)
SEPARATORS = {"tab": "\t", "comma": ",", "semicolon": ";", "space": " "}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of floating columns made missing; other columns are passed on as they are,
    so that conditions on them still reach the scan."""
    floating = [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]
    if not floating:
        return df
    kept = {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floating}
    return df.select(*((kept[f.name].alias(f.name, metadata=f.metadata) if f.name in kept else F.col(f"`{f.name}`")) for f in df.schema))


def use(spark: SparkSession, path: str, rows: int | None = None, schema: str | None = None, nan_missing: bool = True) -> DataFrame:
    """Parquet, lazily; ``rows`` keeps the first so many.  NaN is missing unless
    ``nan_missing`` is off, with which conditions on floating columns reach the scan too."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    df = nan_to_null(df) if nan_missing else df
    return df if rows is None else df.limit(rows)


def encoding_of(spark: SparkSession, path: str) -> str:
    """utf-8 where all lines are, else latin-1, in which every byte is a letter; a
    file in cp1252 or another encoding is to be named as such."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "utf-8" if broken.limit(1).isEmpty() else "ISO-8859-1"


def import_delimited(spark: SparkSession, path: str, delimiter: str = "comma", encoding: str | None = None, schema: str | None = None) -> DataFrame:
    """Delimited text with a header; without a schema one more pass infers it, and
    without an encoding one looks for it."""
    encoding = encoding or encoding_of(spark, path)
    reader = spark.read.option("header", True).option("sep", SEPARATORS.get(delimiter, delimiter)).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def import_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return import_delimited(spark, path, "tab", schema=schema)


def import_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that hold an array of records each, or one record after the other; one
    file is read by as many tasks as it has splits.  Without a schema one more pass
    infers it.  A record that does not parse is a row of nulls."""
    records = json_records(spark, path)
    return records.select(F.from_json("record", schema or schema_of(records)).alias("r")).select("r.*")


def convert(df: DataFrame, path: str, replace: bool = False) -> None:
    """Parquet with zstd."""
    df.write.mode("overwrite" if replace else "errorifexists").option("compression", "zstd").parquet(path)


def save(df: DataFrame, path: str, kind: str = "parquet", replace: bool = False, where: Column | None = None) -> None:
    """Parquet, csv or json; an existing target is an error unless ``replace``."""
    out = df if where is None else df.filter(where)
    writer = out.write.mode("overwrite" if replace else "errorifexists")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def head(df: DataFrame, n: int = 10, cols: list[str] | None = None, where: Column | None = None) -> DataFrame:
    out = df if where is None else df.filter(where)
    return (out.select(*cols) if cols else out).limit(n)


def read_dta(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Labelled statistics files (.dta), one task a file, with the given schema."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in frames:
            for content in pdf["content"]:
                yield pd.read_stata(io.BytesIO(content), convert_categoricals=False)[names]

    return spark.read.format("binaryFile").load(pattern).select("content").mapInPandas(run, schema)


def dta_labels(spark: SparkSession, pattern: str) -> DataFrame:
    """(variable, label) of the files' variable labels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in frames:
            for content in pdf["content"]:
                with pd.io.stata.StataReader(io.BytesIO(content)) as r:
                    labels = r.variable_labels()
                yield pd.DataFrame({"variable": list(labels), "label": list(labels.values())})

    return spark.read.format("binaryFile").load(pattern).select("content").mapInPandas(run, "variable string, label string").distinct()


def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``df`` with variable labels as column metadata."""
    for r in labels.filter(F.col("label") != "").limit(10_000).collect():  # one row a column
        if r["variable"] in df.columns:
            df = df.withMetadata(r["variable"], {"label": r["label"]})
    return df
