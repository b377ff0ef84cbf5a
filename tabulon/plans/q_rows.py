"""Sorting, sampling, appending, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rows as R
from . import query

c = F.col


@query("f1_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST")
def _(t):
    return R.sort(t.customer, "c_acctbal").select("c_custkey", "c_acctbal")


@query("f2_gsort", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice NULLS LAST")
def _(t):
    return R.sort(t.orders, "-o_orderstatus", "o_totalprice").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("f3_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return R.head(t.orders, 25, ["-o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


# which rows are drawn is chance; how many, and that all are rows of the table, is not
@query("f4_sample_percent", "SELECT CAST(round(count(*) * 0.1) AS BIGINT) AS n, CAST(round(count(*) * 0.1) AS BIGINT) AS of_the_table FROM lineitem")
def _(t):
    drawn = R.sample_percent(t.lineitem, 10)
    rows = t.lineitem.groupBy(*t.lineitem.columns).agg(F.count("*").alias("k"))
    got = drawn.groupBy(*drawn.columns).agg(F.count("*").alias("m")).join(rows, drawn.columns)
    return got.agg(F.sum("m").alias("n"), F.sum(F.least("m", "k")).alias("of_the_table"))


@query("f5_sample_rows", "SELECT CAST(2000 AS BIGINT) AS n, CAST(1 AS INTEGER) AS statuses_in_proportion")
def _(t):
    drawn = R.sample_rows(t.orders.select("o_orderstatus", "o_orderpriority"), 2000)
    # five standard errors of a share
    share = lambda rows: rows.groupBy("o_orderstatus").agg(F.count("*").alias("k")).withColumn("s", F.col("k") / rows.count())
    a, b = share(drawn), share(t.orders).select("o_orderstatus", F.col("s").alias("p"))
    off = F.max(F.abs(F.coalesce("s", F.lit(0)) - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")) / 2000 + 1e-12))
    return b.join(a, "o_orderstatus", "left").agg(F.sum("k").alias("n"), (off < 5).cast("int").alias("statuses_in_proportion"))


@query("g1_append", "SELECT c_custkey AS key, c_acctbal AS bal, c_mktsegment AS seg, 0 AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 1 FROM supplier")
def _(t):
    a = t.customer.select(c("c_custkey").alias("key"), c("c_acctbal").alias("bal"), c("c_mktsegment").alias("seg"))
    return R.append(a, t.supplier.select(c("s_suppkey").alias("key"), c("s_acctbal").alias("bal")), "source")


@query("g2_append_force", "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT s_name FROM supplier")
def _(t):
    return R.append(t.customer.select(c("c_custkey").alias("key")), t.supplier.select(c("s_name").alias("key")), force=True)


@query("g3_duplicates_drop", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(t):
    return R.duplicates_drop(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("d16_duplicates_report", "SELECT copies, count(*) AS n_groups, copies * count(*) AS observations, (copies - 1) * count(*) AS surplus FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY copies")
def _(t):
    return R.duplicates_report(t.lineitem, "l_orderkey", "l_linenumber")


@query("e12_duplicates_tag", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) - 1 AS copies FROM lineitem")
def _(t):
    return R.duplicates_tag(t.lineitem, ["l_orderkey", "l_linenumber"], "copies").select("l_orderkey", "l_linenumber", "l_partkey", "copies")


@query("e13_duplicates_list", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def _(t):
    return R.duplicates_list(t.lineitem, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")
