"""Files, and Python over tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import udf
from ..sources import files, html
from ..storage import shared_dir
from . import query

c = F.col


def _place(t, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(t.spark.sparkContext).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a1_use", "SELECT * FROM part")
def _(t):
    return files.use(t.spark, f"{t.folder}/part.parquet")


_PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"
_SCHEMA = "p_partkey bigint, p_name string, p_size int, p_retailprice double"


def _part(t):
    return t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("a2_csv", _PART)
def _(t):
    files.save(_part(t), path := _place(t, "csv"), "csv")
    return files.import_delimited(t.spark, path, schema=_SCHEMA)


@query("a3_tsv", _PART)
def _(t):
    _part(t).write.option("header", True).option("sep", "\t").csv(path := _place(t, "tsv"))
    return files.import_tsv(t.spark, path, _SCHEMA)


@query("a4_json", _PART)
def _(t):
    rows = _part(t).groupBy((c("p_partkey") % 8).alias("k")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size", "p_retailprice"))).alias("value"))
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path := _place(t, "json"))
    return files.import_json(t.spark, path, _SCHEMA)


@query("a5_convert", _PART)
def _(t):
    files.save(_part(t), csv := _place(t, "csv"), "csv")
    files.convert(files.import_delimited(t.spark, csv, schema=_SCHEMA), path := _place(t, "zstd"))
    return files.use(t.spark, path)


@query("a6_html", "SELECT page_id, 1 AS table_idx, CAST(r AS INTEGER) AS row_idx, CASE r WHEN 0 THEN 'id' WHEN 1 THEN CAST(page_id AS VARCHAR) ELSE url END AS first_cell FROM pages, (VALUES (0), (1), (2)) x(r)")
def _(t):
    page = F.concat(F.lit("<table><tr><td>small</td></tr></table>"), "html", F.lit("<table><tr><th>id<th>x</tr><tr><td>"), c("page_id").cast("string"), F.lit("</td></tr><tr><td>"), "url", F.lit("</td></tr></table>"))
    out = html.largest_table(html.html_tables(t.pages.select("page_id", page.alias("html"))))
    return out.select("page_id", "table_idx", "row_idx", F.get("cells", F.lit(0)).alias("first_cell"))


@query("a8_save", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(t):
    files.save(t.orders.select("o_orderkey", "o_totalprice"), path := _place(t, "save"), where=c("o_totalprice") > 100000)
    return files.use(t.spark, path)


@query("a10_preview", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20")
def _(t):
    return files.head(t.orders.orderBy("o_orderkey"), 20, ["o_orderkey"], c("o_orderstatus") == "P")


def _double(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"c_custkey": pdf["c_custkey"], "twice": pdf["c_acctbal"] * 2})


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"c_mktsegment": pdf["c_mktsegment"].iloc[:1], "spread": [pdf["c_acctbal"].max() - pdf["c_acctbal"].min()]})


def _lengths():
    return lambda texts: [float(len(x)) for x in texts]


@query("u1_python", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def _(t):
    return udf.python(t.customer.select("c_custkey", "c_acctbal"), _double, "c_custkey bigint, twice double")


@query("u2_python_by", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def _(t):
    return udf.python_by(t.customer.select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], _spread, "c_mktsegment string, spread double")


@query("u3_score_text", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS score FROM documents")
def _(t):
    return udf.score_text(t.documents, "text", "score", _lengths).select("doc_id", "score")
