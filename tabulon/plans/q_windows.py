"""Group statistics beside rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from . import query, rnd

c = F.col


@query("e1_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS _n, count(*) OVER () AS _N_all, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS of FROM orders")
def _(t):
    all_rows = W.number(t.orders, ["o_orderdate", "o_orderkey"], size="_N_all")
    return W.number(all_rows, ["o_orderdate", "o_orderkey"], ["o_custkey"], "k", "of").select("o_orderkey", "_n", "_N_all", "k", "of")


@query("e2_egen", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey) + 0.000001, 4) AS mean, round(median(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS med, count(*) OVER (PARTITION BY o_custkey) AS n, round(max(o_totalprice) OVER (), 4) AS top FROM orders")
def _(t):
    df = W.egen(W.egen(t.orders, "mean", "mean", "o_totalprice", ["o_custkey"]), "med", "median", "o_totalprice", ["o_custkey"])
    df = W.egen(W.egen(df, "n", "count", "o_totalprice", ["o_custkey"]), "top", "max", "o_totalprice")
    # a mean half-way between two roundings, as cents over eight orders can be, is moved off it
    return df.select("o_orderkey", rnd(c("mean") + 0.000001).alias("mean"), rnd("med").alias("med"), "n", rnd("top").alias("top"))


@query("e3_standardise", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) / stddev_samp(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS z FROM customer")
def _(t):
    return W.standardise(t.customer, "z", "c_acctbal", ["c_mktsegment"]).select("c_custkey", rnd("z", 6).alias("z"))


@query("e4_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS r FROM part")
def _(t):
    return W.rank(t.part, "r", "p_size", ["p_brand"]).select("p_partkey", "r")


@query("e5_group_id", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) AS g FROM customer")
def _(t):
    return W.group_id(t.customer, "g", "c_nationkey", "c_mktsegment").select("c_custkey", "g")


@query("e6_tag", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS INTEGER) AS first FROM orders")
def _(t):
    return W.tag(t.orders, "first", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "first")


@query("e7_seq", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events")
def _(t):
    return W.seq(t.events, "k", ["ts", "event_id"], ["user_id"]).select("event_id", "k")


@query("e8_rowwise", "SELECT l_orderkey, round(l_discount + l_tax + l_quantity, 6) AS total, round((l_discount + l_tax + l_quantity) / 3, 6) AS mean, least(l_discount, l_tax, l_quantity) AS low, greatest(l_discount, l_tax, l_quantity) AS high, CAST(0 AS INTEGER) AS miss FROM lineitem")
def _(t):
    df, v = t.lineitem, ("l_discount", "l_tax", "l_quantity")
    for new, fn in (("total", "rowtotal"), ("mean", "rowmean"), ("low", "rowmin"), ("high", "rowmax"), ("miss", "rowmiss")):
        df = W.rowwise(df, new, fn, *v)
    return df.select("l_orderkey", rnd("total", 6).alias("total"), rnd("mean", 6).alias("mean"), "low", "high", "miss")


@query("e9_concat", "SELECT c_custkey, c_mktsegment || ' ' || c_nationkey AS v FROM customer")
def _(t):
    return W.concat(t.customer, "v", "c_mktsegment", "c_nationkey").select("c_custkey", "v")


@query("e14_difference", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 4) AS d FROM orders")
def _(t):
    return W.difference(t.orders, "d", "o_totalprice", "o_custkey", "o_orderkey").select("o_orderkey", rnd("d").alias("d"))
