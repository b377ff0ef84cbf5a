"""Summaries and quantiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import quantiles as Q
from ..operators import summary as S
from . import query, rnd

c = F.col


def _round(df, *cols, digits=4):
    return df.withColumns({x: rnd(x, digits) for x in cols})


_LI = ("l_quantity", "l_extendedprice", "l_discount")


@query("d1_summarize", " UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS sd, min({v}) AS min, max({v}) AS max FROM lineitem" for v in _LI))
def _(t):
    return _round(S.summarize(t.lineitem, *_LI), "mean", "sd")


@query("d2_summarize_detail", "SELECT variable, n, round(mean, 4) AS mean, round(sd, 4) AS sd, min, max, " + ", ".join(f"round(q[{k + 1}], 4) AS p{p}" for k, p in enumerate(S.PERCENTILES)) + " FROM (SELECT 'c_acctbal' AS variable, count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS min, max(c_acctbal) AS max, quantile_cont(c_acctbal, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM customer)")
def _(t):
    return _round(S.summarize(t.customer, "c_acctbal", detail=True), "mean", "sd", *(f"p{p}" for p in S.PERCENTILES))


@query("d3_weighted", "SELECT l_returnflag, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS mean, round((sum(l_tax * l_tax * l_quantity) - power(sum(l_tax * l_quantity), 2) / sum(l_quantity)) / (sum(l_quantity) - 1), 8) AS fvar, round((sum(l_tax * l_tax * l_quantity) - power(sum(l_tax * l_quantity), 2) / sum(l_quantity)) * count(*) / sum(l_quantity) / (count(*) - 1), 8) AS avar, round((sum(l_tax * l_tax * l_quantity) - power(sum(l_tax * l_quantity), 2) / sum(l_quantity)) / sum(l_quantity), 8) AS ivar FROM lineitem GROUP BY 1")
def _(t):
    kinds, w = ("fweight", "aweight", "iweight"), c("l_quantity")
    var = S.weighted_moments(t.lineitem, ["l_tax"], w, list(kinds), ["l_returnflag"])
    mean = S.collapse(t.lineitem, {"mean": ("mean", "l_tax")}, ["l_returnflag"], weight=w)
    return mean.join(var, "l_returnflag").select("l_returnflag", rnd("mean", 6).alias("mean"), *(rnd(f"var__{k}__l_tax", 8).alias(f"{k[0]}var") for k in kinds))


_MID = """(SELECT {by}x, (cw - w / 2) / tw AS g FROM (SELECT {by}{col} AS x, CAST({w} AS DOUBLE) AS w, sum({w}) OVER ({part}ORDER BY {col}, {w} ROWS UNBOUNDED PRECEDING) AS cw, sum({w}) OVER ({over}) AS tw FROM {table}))"""


def _mid(table, col, p, w="1.0"):
    """SQL of one quantile on the midpoint grid, with ties in the order of weights."""
    grid = _MID.format(by="", col=col, w=w, part="", over="", table=table)
    return f"(SELECT coalesce(CASE WHEN lo.g IS NULL THEN hi.x WHEN hi.g IS NULL OR hi.g = lo.g THEN lo.x ELSE lo.x + (hi.x - lo.x) * ({p} - lo.g) / (hi.g - lo.g) END) FROM (SELECT max(g) AS g, arg_max(x, g) AS x FROM {grid} WHERE g <= {p}) lo, (SELECT min(g) AS g, arg_min(x, g) AS x FROM {grid} WHERE g >= {p}) hi)"


@query("d4_weighted_quantile", " UNION ALL ".join(f"SELECT {p} AS p, round({_mid('events', 'value', p, '(1 + user_id % 3)')}, 4) AS q" for p in ("0.1", "0.25", "0.5", "0.9")))
def _(t):
    return _round(Q.quantile_mid(t.events, "value", [0.1, 0.25, 0.5, 0.9], weight=1 + c("user_id") % 3), "q")


@query("d5_effective_n", "SELECT l_linestatus, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 4) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_linestatus").agg(rnd(S.effective_n(c("l_quantity"))).alias("n"))


@query("d6_tabulate", "SELECT o_orderpriority, count(*) AS freq, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, round(sum(count(*)) OVER (ORDER BY o_orderpriority) * 100.0 / sum(count(*)) OVER (), 6) AS cum FROM orders GROUP BY 1")
def _(t):
    return _round(S.tab1(t.orders, "o_orderpriority"), "percent", "cum", digits=6)


@query("d7_crosstab", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INTEGER) AS margin, count(*) AS freq FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return S.tab2(t.lineitem, "l_returnflag", "l_linestatus")


@query("d8_tabstat", " UNION ALL ".join(f"SELECT c_mktsegment, '{s}' AS stat, round({e}, 4) AS c_acctbal FROM customer GROUP BY 1" for s, e in (("n", "count(c_acctbal)"), ("mean", "avg(c_acctbal)"), ("sd", "stddev_samp(c_acctbal)"), ("median", "median(c_acctbal)"), ("iqr", "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)"), ("range", "max(c_acctbal) - min(c_acctbal)"))))
def _(t):
    return _round(S.tabstat(t.customer, ["c_acctbal"], ["n", "mean", "sd", "median", "iqr", "range"], ["c_mktsegment"]), "c_acctbal")


@query("d9_collapse", "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean_price, round(stddev_samp(l_extendedprice), 4) AS sd_price, round(median(l_quantity), 4) AS med_qty, round(sum(l_quantity), 2) AS sum_qty, count(l_quantity) AS n FROM lineitem GROUP BY ALL")
def _(t):
    specs = {"mean_price": ("mean", "l_extendedprice"), "sd_price": ("sd", "l_extendedprice"), "med_qty": ("median", "l_quantity"), "sum_qty": ("sum", "l_quantity"), "n": ("count", "l_quantity")}
    return _round(_round(S.collapse(t.lineitem, specs, ["l_returnflag", "l_linestatus"]), "mean_price", "sd_price", "med_qty"), "sum_qty", digits=2)


def _mid_by(table, by, col, ps, w):
    """SQL of (by, p, q) on the midpoint grid, by groups."""
    grid = f"SELECT {by}, {col} AS x, (sum({w}) OVER (PARTITION BY {by} ORDER BY {col}, {w} ROWS UNBOUNDED PRECEDING) - {w} / 2) / sum({w}) OVER (PARTITION BY {by}) AS g FROM {table}"
    near = "max(g) FILTER (g <= p) AS g0, arg_max(x, g) FILTER (g <= p) AS x0, min(g) FILTER (g >= p) AS g1, arg_min(x, g) FILTER (g >= p) AS x1"
    between = "CASE WHEN g0 IS NULL THEN x1 WHEN g1 IS NULL OR g1 = g0 THEN x0 ELSE x0 + (x1 - x0) * (p - g0) / (g1 - g0) END"
    return f"(SELECT {by}, p, {between} AS q FROM (SELECT {by}, p, {near} FROM ({grid}), (SELECT CAST(unnest({list(ps)}) AS DOUBLE) AS p) GROUP BY {by}, p))"


# about the mean, since a sum of squares loses the digits that matter
def _var_by(table, by, col, w, denominator):
    return f"(SELECT {by}, sum({w} * power({col} - m, 2)) / ({denominator}) AS v FROM {table} JOIN (SELECT {by}, sum({col} * {w}) / sum({w}) AS m FROM {table} GROUP BY 1) USING ({by}) GROUP BY {by})"


_LW = "(SELECT 1 AS one, l_extendedprice, l_quantity FROM lineitem)"


@query("d2_weighted_detail", f"WITH q AS {_mid_by(_LW, 'one', 'l_extendedprice', [p / 100 for p in S.PERCENTILES], 'l_quantity')} SELECT 'l_extendedprice' AS variable, n, round(mean, 4) AS mean, round(sqrt(v), 4) AS sd, min, max, {', '.join(f'(SELECT round(q, 4) FROM q WHERE p = {p / 100}) AS p{p}' for p in S.PERCENTILES)} FROM (SELECT sum(l_quantity) AS n, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem), {_var_by(_LW, 'one', 'l_extendedprice', 'l_quantity', 'sum(l_quantity) - 1')}")
def _(t):
    out = S.summarize(t.lineitem, "l_extendedprice", weight=c("l_quantity"), wtype="fweight", detail=True)
    return _round(out, "mean", "sd", *(f"p{p}" for p in S.PERCENTILES))


_CW = "(SELECT *, 1.0 + c_nationkey AS w FROM customer)"


@query("d8_tabstat_weighted", f"WITH q AS {_mid_by(_CW, 'c_mktsegment', 'c_acctbal', [0.1, 0.25, 0.5, 0.75], 'w')}, v AS {_var_by(_CW, 'c_mktsegment', 'c_acctbal', 'w', 'sum(w) / count(*) * (count(*) - 1)')} SELECT c_mktsegment, 'sd' AS stat, round(sqrt(v), 4) AS c_acctbal FROM v UNION ALL SELECT c_mktsegment, 'median', round(q, 4) FROM q WHERE p = 0.5 UNION ALL SELECT c_mktsegment, 'p10', round(q, 4) FROM q WHERE p = 0.1 UNION ALL SELECT c_mktsegment, 'iqr', round(max(q) FILTER (p = 0.75) - max(q) FILTER (p = 0.25), 4) FROM q GROUP BY 1")
def _(t):
    rows = t.customer.withColumn("w", F.lit(1.0) + c("c_nationkey"))
    return _round(S.tabstat(rows, ["c_acctbal"], ["sd", "median", "p10", "iqr"], ["c_mktsegment"], weight=c("w")), "c_acctbal")


@query("d9_collapse_weighted", f"WITH q AS {_mid_by('lineitem', 'l_suppkey', 'l_extendedprice', [0.5, 0.9], 'l_quantity')}, v AS {_var_by('lineitem', 'l_suppkey', 'l_extendedprice', 'l_quantity', 'sum(l_quantity) / count(*) * (count(*) - 1)')} SELECT l_suppkey, round(mean, 4) AS mean, round(sqrt(v), 4) AS sd, (SELECT round(any_value(q), 4) FROM q WHERE q.l_suppkey = m.l_suppkey AND p = 0.5) AS med, (SELECT round(any_value(q), 4) FROM q WHERE q.l_suppkey = m.l_suppkey AND p = 0.9) AS p90 FROM (SELECT l_suppkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1) m JOIN v USING (l_suppkey)")
def _(t):
    specs = {"mean": ("mean", "l_extendedprice"), "sd": ("sd", "l_extendedprice"), "med": ("median", "l_extendedprice"), "p90": ("p90", "l_extendedprice")}
    return _round(S.collapse(t.lineitem, specs, ["l_suppkey"], weight=c("l_quantity")), *specs)


@query("d10_contract", "SELECT user_id, event_type, freq, CAST(sum(freq) OVER (ORDER BY freq DESC, user_id, event_type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cfreq, round(freq * 100.0 / sum(freq) OVER (), 4) AS percent FROM (SELECT user_id, event_type, count(*) AS freq FROM events GROUP BY ALL)")
def _(t):
    return S.contract(t.events, "user_id", "event_type")


@query("d11_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def _(t):
    return S.count_if(t.orders, c("o_totalprice") > 100000)


def _profile(v, kind):
    q = lambda e: f"round({e}, 6)" if kind != "string" else "CAST(NULL AS DOUBLE)"
    top = f"(SELECT string_agg(CAST(v AS VARCHAR) || ' (' || k || ')', '; ' ORDER BY k DESC, v) FROM (SELECT {v} AS v, count(*) AS k FROM part WHERE {v} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 3))"
    quartiles = ", ".join(q(f"quantile_cont({v}, {p / 100})") + f" AS p{p}" for p in (25, 50, 75))
    return f"SELECT '{v}' AS variable, '' AS label, '{kind}' AS type, count({v}) AS n, count(*) - count({v}) AS missing, count(DISTINCT {v}) AS distinct_values, CAST(min({v}) AS VARCHAR) AS min, CAST(max({v}) AS VARCHAR) AS max, {q(f'avg({v})')} AS mean, {q(f'stddev_samp({v})')} AS sd, {quartiles}, {top} AS top FROM part"


@query("d12_codebook", " UNION ALL ".join(_profile(v, k) for v, k in (("p_partkey", "bigint"), ("p_brand", "string"), ("p_size", "int"))))
def _(t):
    return _round(S.codebook(t.part, "p_partkey", "p_brand", "p_size"), "mean", "sd", "p25", "p50", "p75", digits=6)


@query("d6_tabulate_sort", "SELECT p_size, count(*) AS freq, round(sum(count(*)) OVER (ORDER BY count(*) DESC, p_size) * 100.0 / sum(count(*)) OVER (), 6) AS cum FROM part GROUP BY 1")
def _(t):
    return _round(S.tab1(t.part, "p_size", sort=True), "cum", digits=6).select("p_size", "freq", "cum")


@query("d13_levelsof", "SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL")
def _(t):
    return S.levelsof(t.part, "p_size")


@query("d14_distinct", "SELECT count(*) AS n_distinct FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def _(t):
    return S.distinct_count(t.lineitem, "l_partkey", "l_suppkey")


@query("d15_isid", "SELECT count(*) AS n FROM orders")
def _(t):
    from ..operators.joins import check_key

    return S.count_if(check_key(t.orders, "o_orderkey"))


@query("d17_assert", "SELECT count(*) AS n, count(*) FILTER (NOT l_discount < 0.1) AS failed FROM lineitem")
def _(t):
    return S.assert_all(t.lineitem, c("l_discount") < 0.1)


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[: i + 1]]


@query("d18_correlate", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in _PAIRS))
def _(t):
    return _round(S.correlate(t.lineitem, *_NUM), "r", digits=8)


# 59,998 degrees of freedom and more: the 5 % point of t is that of the normal
_R = "(SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM lineitem)"


@query("d19_pwcorr", " UNION ALL ".join(f"SELECT a, b, n, round(r, 8) AS r, abs(r) * sqrt((n - 2) / (1 - r * r)) > 1.95996 AS star FROM {_R.format(a=a, b=b)}" for a, b in _PAIRS if a != b))
def _(t):
    return _round(S.pwcorr(t.lineitem, *_NUM), "r", digits=8).drop("p")


_T1 = "count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS sd, round((avg({v}) - {m}) / (stddev_samp({v}) / sqrt(count({v}))), 6) AS t, count({v}) - 1 AS df"


@query("d20_ttest_one", f"SELECT {_T1.format(v='c_acctbal', m=4500)} FROM customer")
def _(t):
    return _round(_round(S.ttest_one(t.customer, "c_acctbal", 4500), "mean", "sd"), "t", digits=6).drop("p")


@query("d21_ttest_paired", f"SELECT {_T1.format(v='d', m=0)} FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def _(t):
    return _round(_round(S.ttest_paired(t.lineitem, "l_discount", "l_tax"), "mean", "sd"), "t", digits=6).drop("p")


_T2 = "(SELECT avg(v) FILTER (NOT g) AS m1, avg(v) FILTER (g) AS m2, var_samp(v) FILTER (NOT g) AS v1, var_samp(v) FILTER (g) AS v2, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n1, CAST(count(*) FILTER (g) AS DOUBLE) AS n2 FROM (SELECT l_extendedprice AS v, l_linestatus = 'O' AS g FROM lineitem))"


@query("d22_ttest_two", f"SELECT 'pooled' AS kind, round(m1 - m2, 4) AS difference, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, n1 + n2 - 2 AS df FROM {_T2} UNION ALL SELECT 'welch', round(m1 - m2, 4), round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6), round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) FROM {_T2}")
def _(t):
    return _round(_round(S.ttest_two(t.lineitem, "l_extendedprice", "l_linestatus"), "difference", "df"), "t", digits=6).drop("p")


def _centile_sql(p: str) -> str:
    """The order statistics at the binomial quantiles of 2.5 % and 97.5 %."""
    rank = lambda q: f"(SELECT min(k) FROM b WHERE cdf >= {q})"
    value = lambda r: f"(SELECT c_acctbal FROM o WHERE i = least(greatest({r}, 0), n.n - 1))"
    return f"""SELECT * FROM (WITH n AS (SELECT count(*) AS n FROM customer), o AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) - 1 AS i FROM customer),
    b AS (SELECT k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p}))) OVER (ORDER BY k) AS cdf FROM (SELECT n, CAST(unnest(range(0, n + 1)) AS DOUBLE) AS k FROM n))
    SELECT {p} AS p, round({_mid('customer', 'c_acctbal', p)}, 4) AS q, {value(rank(0.025))} AS low, {value(rank(0.975) + ' + 1')} AS high FROM n)"""


@query("d23_centile", " UNION ALL ".join(_centile_sql(p) for p in ("0.25", "0.5", "0.75")))
def _(t):
    return _round(Q.centile(t.customer, "c_acctbal", [25, 50, 75]), "q")


@query("d24_pctile", " UNION ALL ".join(f"SELECT {p} AS p, round({_mid('customer', 'c_acctbal', p)}, 4) AS q" for p in ("0.2", "0.4", "0.6", "0.8")))
def _(t):
    return _round(Q.pctile(t.customer, "c_acctbal", 5), "q")


def _describe_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"event_type": pdf["event_type"].iloc[:1], "n": [len(pdf)], "top": [pdf["value"].max()]})


@query("d25_by_group", "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def _(t):
    return S.by_group(t.events.select("event_type", "value"), ["event_type"], _describe_group, "event_type string, n bigint, top double")


@query("e10_xtile", f"SELECT c_custkey, CAST(1 + (c_acctbal >= {_mid('customer', 'c_acctbal', '0.25')})::INT + (c_acctbal >= {_mid('customer', 'c_acctbal', '0.5')})::INT + (c_acctbal >= {_mid('customer', 'c_acctbal', '0.75')})::INT AS INTEGER) AS class FROM customer")
def _(t):
    return Q.xtile(t.customer, "class", "c_acctbal", 4).select("c_custkey", "class")


@query("e11_winsor", f"SELECT c_custkey, round(greatest(least(c_acctbal, {_mid('customer', 'c_acctbal', '0.95')}), {_mid('customer', 'c_acctbal', '0.05')}), 4) AS c_acctbal_w FROM customer")
def _(t):
    return _round(Q.winsor(t.customer, ["c_acctbal"], (5, 95)), "c_acctbal_w").select("c_custkey", "c_acctbal_w")
