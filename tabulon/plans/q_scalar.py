"""Scalar functions on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from . import query, rnd

c = F.col


#: name, table, key, expression, SQL of the expression
SCALARS = [
    ("h1_arithmetic", "lineitem", ["l_orderkey"], lambda: rnd(S.divide(c("l_extendedprice"), c("l_quantity")) - c("l_discount") + S.power(c("l_tax"), F.lit(2)) * -1, 7), "round(l_extendedprice / l_quantity - l_discount + power(l_tax, 2) * -1, 7)"),
    ("h2_compare", "orders", ["o_orderkey"], lambda: (c("o_totalprice") >= 100000) & S.ne_missing(c("o_orderstatus"), F.lit("F")), "o_totalprice >= 100000 AND o_orderstatus IS DISTINCT FROM 'F'"),
    ("h3_logic", "orders", ["o_orderkey"], lambda: (c("o_orderstatus") == "O") & ~(c("o_totalprice") > 200000) | (c("o_orderpriority") == "1-URGENT"), "o_orderstatus = 'O' AND NOT (o_totalprice > 200000) OR o_orderpriority = '1-URGENT'"),
    ("h4_missing", "customer", ["c_custkey"], lambda: S.missing(F.when(c("c_acctbal") > 0, c("c_acctbal"))), "(CASE WHEN c_acctbal > 0 THEN c_acctbal END) IS NULL"),
    ("h5_inrange", "part", ["p_partkey"], lambda: S.inrange(c("p_size"), 10, 20), "p_size BETWEEN 10 AND 20"),
    ("h6_inlist", "part", ["p_partkey"], lambda: S.inlist(c("p_size"), 1, 5, 9, 15), "p_size IN (1, 5, 9, 15)"),
    ("h7_regexm", "part", ["p_partkey"], lambda: S.regexm(c("p_name"), "^[a-m].*e"), "coalesce(regexp_matches(p_name, '^[a-m].*e'), false)"),
    ("h8_regexr", "part", ["p_partkey"], lambda: S.regexr(c("p_name"), "[aeiou]", "_"), "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
    ("h9_regexs", "part", ["p_partkey"], lambda: S.regexs(c("p_brand"), "([0-9])([0-9])", 2), "CASE WHEN regexp_matches(p_brand, '([0-9])([0-9])') THEN regexp_extract(p_brand, '([0-9])([0-9])', 2) END"),
    ("h10_substr", "customer", ["c_custkey"], lambda: S.substr(c("c_name"), 3, 8), "substr(c_name, 3, 8)"),
    ("h11_strlen", "documents", ["doc_id"], lambda: S.strlen(c("text")), "CAST(length(text) AS INTEGER)"),
    ("h12_upper_lower", "part", ["p_partkey"], lambda: F.concat(F.upper("p_name"), F.lower("p_brand")), "upper(p_name) || lower(p_brand)"),
    ("h13_trim", "part", ["p_partkey"], lambda: F.concat(S.trim(F.concat(F.lit("  "), "p_name", F.lit("\t "))), F.lit("|"), S.ltrim(F.concat(F.lit(" \t"), "p_brand")), S.rtrim(F.concat("p_type", F.lit("\n")))), "p_name || '|' || p_brand || p_type"),
    ("h14_word", "documents", ["doc_id"], lambda: S.word(c("text"), 2), r"regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[2]"),
    ("h15_strmatch", "part", ["p_partkey"], lambda: S.strmatch(c("p_name"), "[b-f]|s"), "regexp_matches(p_name, '^(?:[b-f]|s)')"),
    ("h16_strpos", "part", ["p_partkey"], lambda: S.strpos(c("p_name"), "e"), "CAST(strpos(p_name, 'e') AS INTEGER)"),
    ("h17_subinstr", "part", ["p_partkey"], lambda: S.subinstr(c("p_name"), "a", "AA"), "replace(p_name, 'a', 'AA')"),
    ("h18_real", "part", ["p_partkey"], lambda: S.real(F.substring("p_brand", 7, 2)), "TRY_CAST(nullif(substr(p_brand, 7, 2), '') AS DOUBLE)"),
    ("h19_string", "part", ["p_partkey"], lambda: S.string(c("p_size")), "CAST(p_size AS VARCHAR)"),
    ("h20_math", "customer", ["c_custkey"], lambda: rnd(F.abs("c_acctbal") + F.ceil("c_acctbal") + F.floor("c_acctbal") + F.coalesce(S.sqrt(c("c_acctbal")), F.lit(0)) + F.exp(c("c_acctbal") / 10000)), "round(abs(c_acctbal) + ceil(c_acctbal) + floor(c_acctbal) + CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) ELSE 0 END + exp(c_acctbal / 10000), 4)"),
    ("h21_log", "customer", ["c_custkey"], lambda: rnd(S.ln(c("c_acctbal")) + S.log10(c("c_acctbal")), 6), "round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) + log10(c_acctbal) END, 6)"),
    ("h22_round", "part", ["p_partkey"], lambda: S.round_even(c("p_size") / 2), "CAST(round_even(p_size / 2, 0) AS DOUBLE)"),
    ("h23_trunc", "customer", ["c_custkey"], lambda: S.trunc(c("c_acctbal")), "CAST(trunc(c_acctbal) AS BIGINT)"),
    ("h24_mod", "customer", ["c_custkey"], lambda: S.mod(c("c_custkey") - 700, F.lit(-7)), "CAST((c_custkey - 700) + 7 * floor((c_custkey - 700) / -7.0) AS BIGINT)"),
    ("h25_min_max", "lineitem", ["l_orderkey"], lambda: S.max2(c("l_discount"), c("l_tax")) - S.min2(c("l_discount"), F.when(c("l_tax") > 0, c("l_tax"))), "greatest(l_discount, l_tax) - CASE WHEN l_tax > 0 THEN least(l_discount, l_tax) END"),
    ("h26_cond", "orders", ["o_orderkey"], lambda: S.cond(c("o_totalprice") > 150000, "large", "small"), "CASE WHEN o_totalprice > 150000 THEN 'large' ELSE 'small' END"),
    ("h27_concat", "customer", ["c_custkey"], lambda: S.concat(c("c_name"), F.lit("/"), c("c_mktsegment"), c("c_nationkey")), "c_name || '/' || c_mktsegment || c_nationkey"),
]

for _name, _table, _keys, _expr, _sql in SCALARS:
    query(_name, f"SELECT {', '.join(_keys)}, {_sql} AS v FROM {_table}")(
        lambda t, table=_table, keys=_keys, expr=_expr: getattr(t, table).select(*keys, expr().alias("v"))
    )
