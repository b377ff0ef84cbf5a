"""The tables behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as M
from . import query, rnd
from .models_sql import least_squares

c = F.col


@query("m1_histogram", "WITH r AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 20 AS w, count(*) AS n FROM customer), k AS (SELECT least(CAST(floor((c_acctbal - lo) / w) AS INTEGER), 19) AS bin, count(*) AS n FROM customer, r GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, coalesce(k.n, 0) AS n, round(coalesce(k.n, 0) / (r.n * w), 9) AS density FROM r, (SELECT unnest(range(0, 20)) AS b) g LEFT JOIN k ON k.bin = b")
def _(t):
    return M.histogram(t.customer, "c_acctbal", 20).select("bin", "n", rnd("density", 9).alias("density"))


@query("m2_kdensity", "WITH r AS (SELECT count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, stddev_samp(p_retailprice) AS sd FROM part), g AS (SELECT i, lo - sd + i * (hi - lo + 2 * sd) / 299 AS x, power(n, -0.2) * sd AS h, n FROM r, (SELECT unnest(range(0, 300)) AS i)) SELECT round(x, 4) AS x, round(sum(exp(-power((p_retailprice - x) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density FROM part, g GROUP BY x")
def _(t):
    return M.kdensity(t.part, "p_retailprice", exact=True).select(rnd("x").alias("x"), rnd("density", 9).alias("density"))


# 500 steps; each value is shared between its two neighbours on the grid
_BINNED = """
WITH r AS (SELECT count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, stddev_samp(l_extendedprice) AS sd FROM lineitem
), a AS (SELECT (l_extendedprice - lo) / ((hi - lo) / 500) AS place, floor((l_extendedprice - lo) / ((hi - lo) / 500)) AS cell FROM lineitem, r
), b AS (SELECT b, sum(s) AS k FROM (SELECT cell AS b, 1 - (place - cell) AS s FROM a UNION ALL SELECT cell + 1, place - cell FROM a) GROUP BY b
), g AS (SELECT unnest(range(0, 300)) AS i
), x AS (SELECT i, lo - sd + i * (hi - lo + 2 * sd) / 299 AS x, power(n, -0.2) * sd AS h, n, lo, hi FROM g, r)
SELECT round(x, 4) AS x, round(sum(k * exp(-power((lo + b * (hi - lo) / 500 - x) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM x, b GROUP BY i, x
"""


@query("m2_kdensity_binned", _BINNED)
def _(t):
    return M.kdensity(t.lineitem, "l_extendedprice", bins=500).select(rnd("x").alias("x"), rnd("density", 9).alias("density"))


@query("m3_scatter", "WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem) SELECT CAST(least(floor((l_quantity - x0) * 10 / (x1 - x0)), 9) AS INTEGER) AS cx, CAST(least(floor((l_discount - y0) * 10 / (y1 - y0)), 9) AS INTEGER) AS cy, count(*) AS n, round(avg(l_quantity), 6) AS x FROM lineitem, r GROUP BY ALL")
def _(t):
    return M.scatter(t.lineitem, "l_discount", "l_quantity", cells=10).select("cx", "cy", "n", rnd("x", 6).alias("x"))


@query("m3_linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(t):
    return M.linear_fit(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", rnd("slope").alias("slope"), rnd("intercept", 2).alias("intercept"), "n")


@query("m4_bar", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(t):
    return M.bar(t.orders, "o_totalprice", ["o_orderpriority"]).withColumn("mean", rnd("mean"))


@query("m5_box", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outside FROM events JOIN q USING (event_type) GROUP BY ALL")
def _(t):
    out = M.box(t.events, "value", ["event_type"])
    return out.withColumns({k: rnd(k, 6) for k in ("q1", "median", "q3")})


@query("m6_line", "SELECT o_orderstatus, year(o_orderdate) AS year, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY ALL")
def _(t):
    df = t.orders.withColumn("year", F.year("o_orderdate").cast("bigint"))
    return M.line(df, "o_totalprice", "year", ["o_orderstatus"]).withColumn("o_totalprice", rnd("o_totalprice"))


@query("m7_fit_band", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(1.96 * sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*)), 2) AS band FROM lineitem")
def _(t):
    return M.fit_band(t.lineitem, "l_extendedprice", "l_quantity").select(rnd("slope").alias("slope"), rnd("intercept", 2).alias("intercept"), rnd("band", 2).alias("band"))


# about 25, which spans the same space
_SQUARE = least_squares("o", "SELECT l_extendedprice AS y, [1, l_quantity - 25, (l_quantity - 25) * (l_quantity - 25)]::DOUBLE[] AS x FROM lineitem", 3)


@query("m7_quadratic", f"WITH RECURSIVE {_SQUARE} SELECT round(b[1] - 25 * b[2] + 625 * b[3], 3) AS c0, round(b[2] - 50 * b[3], 4) AS c1, round(b[3], 5) AS c2 FROM ob")
def _(t):
    fit = M.quadratic_fit(t.lineitem, "l_extendedprice", "l_quantity")
    return fit.select(rnd("c0", 3).alias("c0"), rnd("c1").alias("c1"), rnd("c2", 5).alias("c2"))


@query("m7_area", "SELECT l_quantity, round(s, 2) AS l_tax, round(sum(s) OVER (ORDER BY l_quantity), 2) AS total FROM (SELECT l_quantity, sum(l_tax) AS s FROM lineitem GROUP BY 1)")
def _(t):
    return M.area(t.lineitem, "l_tax", "l_quantity").select("l_quantity", rnd("l_tax", 2).alias("l_tax"), rnd("total", 2).alias("total"))
