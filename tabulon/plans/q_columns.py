"""Columns and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C
from . import query, rnd

c = F.col


@query("b1_generate", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice > 1000 THEN o_totalprice / 2 END AS FLOAT) AS half FROM orders")
def _(t):
    return C.generate(t.orders, "half", c("o_totalprice") / 2, c("o_totalprice") > 1000, "float").select("o_orderkey", "half")


@query("b2_replace", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    return C.replace(t.customer, "c_acctbal", F.lit(0.0), c("c_acctbal") < 0).select("c_custkey", "c_acctbal")


@query("b3_rename", "SELECT n_nationkey AS id, n_name, n_regionkey FROM nation")
def _(t):
    return C.rename(C.with_label(t.nation, "n_nationkey", "key"), "n_nationkey", "id")


@query("b4_drop_columns", "SELECT o_custkey, o_totalprice FROM orders")
def _(t):
    return C.drop(t.orders, "o_order*")


@query("b5_keep_columns", "SELECT p_size, p_name, p_partkey FROM part")
def _(t):
    return C.keep(t.part, "p_size", "p_name", "p_partk*")


@query("b6_drop_if", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END > 5000, false)")
def _(t):
    return C.drop_if(t.customer, F.when(c("c_acctbal") > 0, c("c_acctbal")) > 5000).select("c_custkey", "c_acctbal")


@query("b7_keep_if", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_quantity < 10")
def _(t):
    return C.keep_if(t.lineitem, (c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")) & (c("l_quantity") < 10)).select("l_orderkey", "l_quantity")


@query("b8_in_range", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n BETWEEN 11 AND 200")
def _(t):
    from ..operators.rows import in_range

    return in_range(t.orders, ["-o_totalprice", "o_orderkey"], 11, 200, c("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")


@query("b9_order", "SELECT p_brand, p_partkey, p_type, p_name, p_size, p_retailprice FROM part")
def _(t):
    return C.order(C.order(t.part, "p_brand"), "p_type", how="after", at="p_partkey")


@query("b10_recode", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 11 WHEN p_size IN (20, 30) THEN 99 ELSE 0 END AS size_class FROM part")
def _(t):
    # sequential: 1-10 become 5, then 5 becomes 11
    return C.recode(t.part, "p_size", [((1, 10), 5), (5, 11), ([20, 30], 99), ("else", 0)], "size_class").select(
        "p_partkey", F.when(c("p_size") == 5, 11).otherwise(c("size_class")).alias("size_class")
    )


@query("b11_destring", "SELECT p_partkey, CAST(substr(p_brand, 7) AS DOUBLE) AS v, p_type AS k FROM part")
def _(t):
    df = t.part.select("p_partkey", F.concat(F.lit("$ "), F.substring("p_brand", 7, 5), F.lit("%")).alias("v"), c("p_type").alias("k"))
    return C.destring(df, "v", "k")


@query("b12_tostring", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE '' END AS v FROM customer")
def _(t):
    return C.tostring(t.customer.select("c_custkey", F.when(c("c_acctbal") > 0, F.floor("c_acctbal")).alias("v")), "v")


@query("b13_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS code FROM orders")
def _(t):
    return C.encode(t.orders, "o_orderpriority", "code").select("o_orderkey", "code")


@query("b14_split", "SELECT p_partkey, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part")
def _(t):
    return C.split(t.part, "p_name", "w", " ", 2).select("p_partkey", "w1", "w2")


@query("b15_clone", "SELECT n_nationkey, n_name, n_name AS again FROM nation")
def _(t):
    return C.clone(t.nation, "n_name", "again").select("n_nationkey", "n_name", "again")


@query("b16_compress", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice FROM orders")
def _(t):
    return C.compress(t.orders.select("o_orderkey", "o_custkey", "o_totalprice")).select(c("o_orderkey").cast("bigint"), c("o_custkey").cast("bigint"), "o_totalprice")


@query("b17_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    return C.decode(C.with_value_labels(t.orders, "o_orderstatus", {"F": "filled", "O": "open"}), "o_orderstatus", "status").select("o_orderkey", "status")


@query("b18_to_long", "SELECT p_partkey, k AS j, CASE k WHEN 1 THEN p_size ELSE p_size * 2 END AS v FROM part, (VALUES (1), (2)) x(k)")
def _(t):
    wide = t.part.select("p_partkey", c("p_size").alias("v1"), (c("p_size") * 2).alias("v_2"))
    return C.to_long(wide, ["v"], ["p_partkey"], "j")


@query("b19_to_wide", "SELECT conv_id, max(role) FILTER (turn = 0) AS role0, max(role) FILTER (turn = 1) AS role1, max(role) FILTER (turn = 2) AS role2 FROM conversations GROUP BY conv_id")
def _(t):
    return C.to_wide(t.conversations.select("conv_id", "turn", "role"), ["role"], ["conv_id"], "turn", [0, 1, 2])
