"""Panels and differences in differences on views of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..estimate import did, panel, post
from . import models_sql as M
from . import query, rnd
from .q_estimate import rounded

c = F.col


def cust_year(t):
    """Orders by customer and year, an unbalanced panel."""
    y = t.orders.groupBy(c("o_custkey").alias("cust"), F.year("o_orderdate").alias("year"))
    return y.agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"))


def staggered(t):
    """Nations by years 1995-2000, completed with zeros, with treatment cohorts
    1997-1999 by nation and a known effect of 0.5."""
    cust = t.customer.select("c_custkey", "c_nationkey")
    sums = t.orders.join(cust, c("o_custkey") == c("c_custkey")).groupBy(c("c_nationkey").alias("unit"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("s"))
    grid = t.nation.select(c("n_nationkey").alias("unit"), F.explode(F.sequence(F.lit(1995), F.lit(2000))).alias("year"))
    first = F.when(c("unit") % 4 == 0, 0).otherwise(c("unit") % 4 + 1996)
    rows = grid.join(sums, ["unit", "year"], "left").withColumn("first_treat", first)
    rows = rows.withColumn("treated", ((c("first_treat") > 0) & (c("year") >= c("first_treat"))).cast("int"))
    return rows.withColumn("y", F.ln(1 + F.coalesce("s", F.lit(0.0))) + 0.5 * c("treated")).withColumn("ever", (c("first_treat") > 0).cast("int")).drop("s")


_CY = "(SELECT o_custkey AS cust, year(o_orderdate) AS year, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY ALL)"
_ST = "(SELECT *, ln(1 + coalesce(s, 0)) + 0.5 * treated AS y, CAST(first_treat > 0 AS INTEGER) AS ever FROM (SELECT *, CAST(first_treat > 0 AND year >= first_treat AS INTEGER) AS treated FROM (SELECT g.unit, g.year, s, CASE WHEN g.unit % 4 = 0 THEN 0 ELSE g.unit % 4 + 1996 END AS first_treat FROM (SELECT n_nationkey AS unit, unnest(range(1995, 2001)) AS year FROM nation) g LEFT JOIN (SELECT c_nationkey AS unit, year(o_orderdate) AS year, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) x ON g.unit = x.unit AND g.year = x.year)))"
_DD = "(SELECT y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS yy, treated - avg(treated) OVER (PARTITION BY unit) - avg(treated) OVER (PARTITION BY year) + avg(treated) OVER () AS dd FROM {0})".format(_ST)


@query("l1_xtset", f"SELECT count(*) AS n_panels, CAST(sum(t) AS BIGINT) AS n_rows, min(t) AS t_min, max(t) AS t_max, round(avg(t), 6) AS t_mean, min(t) = (SELECT count(DISTINCT year) FROM {_CY}) AS balanced FROM (SELECT cust, count(*) AS t FROM {_CY} GROUP BY 1)")
def _(t):
    return panel.xtset(cust_year(t), "cust", "year").withColumn("t_mean", rnd("t_mean", 6))


_WITHIN = f"cy AS MATERIALIZED (SELECT cust, n - avg(n) OVER w AS n, spent - avg(spent) OVER w AS y FROM {_CY} WINDOW w AS (PARTITION BY cust)), "


@query("l2_xtreg_fe", M.regression("SELECT y, [n]::DOUBLE[] AS x FROM cy", ["n"], 2, df_used="(SELECT count(DISTINCT cust) FROM cy)", before=_WITHIN))
def _(t):
    return rounded(panel.xtreg_fe(cust_year(t), "spent", ["n"], "cust").coefficients(t.spark), 2)


_RE = f"""cy AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY cust) AS size, avg(n) OVER (PARTITION BY cust) AS mn, avg(spent) OVER (PARTITION BY cust) AS ms FROM {_CY}),
fe AS (SELECT (fsum(b * b) - fsum(a * b) * fsum(a * b) / fsum(a * a)) / (count(*) - count(DISTINCT cust) - 1) AS s2e FROM (SELECT cust, n - mn AS a, spent - ms AS b FROM cy)),
be AS (SELECT regr_syy(ms, mn) * (1 - regr_r2(ms, mn)) / (count(*) - 2) AS s2b, count(*) / fsum(1.0 / size) AS harmonic FROM (SELECT DISTINCT cust, size, mn, ms FROM cy)),
th AS MATERIALIZED (SELECT cy.*, 1 - sqrt(s2e / (size * greatest(s2b - s2e / harmonic, 0) + s2e)) AS theta FROM cy, fe, be), """


@query("l3_xtreg_re", M.regression("SELECT spent - theta * ms AS y, [n - theta * mn, 1 - theta]::DOUBLE[] AS x FROM th", ["n", "_one"], 2, before=_RE))
def _(t):
    return rounded(panel.xtreg_re(cust_year(t), "spent", ["n"], "cust").coefficients(t.spark), 2)


@query("l4_twfe", M.regression(f"SELECT yy AS y, [dd]::DOUBLE[] AS x FROM {_DD}", ["treated"], 6, df_used="30"))
def _(t):
    return rounded(did.twfe(staggered(t), "y", "treated", "unit", "year").coefficients(t.spark), 6)


_FOUR = f"SELECT y, [ever, CAST(year >= 1998 AS INTEGER), ever * CAST(year >= 1998 AS INTEGER), 1]::DOUBLE[] AS x FROM {_ST}"


@query("l5_did2x2", f"WITH RECURSIVE {M.least_squares('o', _FOUR, 4)}, {M.covariance('o', 4)} {M.inference(M.effects('o', {'did': [0, 0, 1, 0]}), 6)}")
def _(t):
    df = staggered(t)
    return rounded(did.did2x2(df, "y", "ever", did.post_indicator(df, "year", [1998, 1999, 2000])), 6)


@query("l6_first_treatment", f"SELECT unit, year, CAST(coalesce(min(CASE WHEN treated = 1 THEN year END) OVER (PARTITION BY unit), 0) AS INTEGER) AS first_treat, CAST(max(treated) OVER (PARTITION BY unit) AS INTEGER) AS ever_treated FROM {_ST}")
def _(t):
    out = did.first_treatment(staggered(t).drop("first_treat"), "treated", "unit", "year")
    return out.select("unit", "year", c("first_treat").cast("int").alias("first_treat"), "ever_treated")


_GT = f"""WITH s AS (SELECT * FROM {_ST}), p AS (SELECT g.first_treat AS g, a.unit, a.year AS t, a.y - b.y AS d, a.first_treat AS own FROM (SELECT DISTINCT first_treat FROM s WHERE first_treat > 0) g JOIN s a ON a.first_treat IN (0, g.first_treat) JOIN s b ON b.unit = a.unit AND b.year = g.first_treat - 1),
c AS (SELECT g, t, avg(d) FILTER (own > 0) - avg(d) FILTER (own = 0) AS att, count(*) FILTER (own > 0) AS n FROM p GROUP BY g, t)"""


_INF = _GT + """, m AS (SELECT g, t, avg(d) FILTER (own > 0) AS m1, avg(d) FILTER (own = 0) AS m0, count(*) FILTER (own > 0) AS n1, count(*) FILTER (own = 0) AS n0 FROM p GROUP BY g, t),
w AS (SELECT *, n1 * 1.0 / sum(n1) OVER (PARTITION BY t - g) AS w FROM m),
f AS (SELECT p.t - p.g AS key, unit, sum(w * CASE WHEN own > 0 THEN (d - m1) / n1 ELSE -(d - m0) / n0 END) AS f FROM p JOIN w ON p.g = w.g AND p.t = w.t GROUP BY 1, 2),
s AS (SELECT key, sqrt(sum(f * f)) AS se FROM f GROUP BY key)"""


@query("l7_callaway_santanna", _INF.replace(", s AS (SELECT key", ", z AS (SELECT key").replace(",\ns AS (SELECT key", ",\nz AS (SELECT key") + " SELECT CAST(t - g AS INTEGER) AS key, round(sum(att * n) / sum(n), 7) AS att, round(any_value(se), 7) AS se, CAST(sum(n) AS BIGINT) AS n FROM c JOIN z ON z.key = t - g GROUP BY 1")
def _(t):
    out = did.callaway_santanna(staggered(t), "y", "unit", "year", "first_treat", "event_study")
    return out.select(c("key").cast("int").alias("key"), rnd("att", 7).alias("att"), rnd("se", 7).alias("se"), "n")


@query("l7_att_gt", _GT + " SELECT CAST(g AS INTEGER) AS g, CAST(t AS INTEGER) AS t, round(att, 7) AS att, n FROM c")
def _(t):
    return did.att_gt(staggered(t), "y", "unit", "year", "first_treat").select("g", "t", rnd("att", 7).alias("att"), "n")


# cohort x relative time, without -1: the place of a dummy is that of its cell
_SA_CELLS = [(g, t - g) for g in (1997, 1998, 1999) for t in range(1995, 2001) if t - g != -1]
_SA_KEYS = sorted({e for _, e in _SA_CELLS})
_SA_BEFORE = f"""st AS MATERIALIZED (SELECT * FROM {_ST}),
sx AS (SELECT unit, year, y, unnest(range(1, {len(_SA_CELLS) + 1})) AS i, unnest([{", ".join(f"CAST(first_treat = {g} AND year - first_treat = {e} AS DOUBLE)" for g, e in _SA_CELLS)}]) AS z FROM st),
flat AS (SELECT unit, year, i, y - avg(y) OVER u - avg(y) OVER t + avg(y) OVER a AS y, z - avg(z) OVER u - avg(z) OVER t + avg(z) OVER a AS z FROM sx WINDOW u AS (PARTITION BY unit, i), t AS (PARTITION BY year, i), a AS (PARTITION BY i)), """
_SA_ROWS = "SELECT any_value(y) AS y, list(z ORDER BY i) AS x, unit AS cl FROM flat GROUP BY unit, year"
# all cells of a relative time weigh by the units of their cohort
_SA_W = f"w AS MATERIALIZED (SELECT e, list(CASE WHEN r = e THEN n ELSE 0 END / s ORDER BY i) AS c, any_value(s) AS n FROM (SELECT k.e, c.i, c.e AS r, n * 1.0 AS n, fsum(CASE WHEN c.e = k.e THEN n * 1.0 ELSE 0 END) OVER (PARTITION BY k.e) AS s FROM (SELECT unnest([{', '.join(str(e) for e in _SA_KEYS)}]) AS e) k, (VALUES {', '.join(f'({i}, {g}, {e})' for i, (g, e) in enumerate(_SA_CELLS))}) c(i, g, e) JOIN (SELECT first_treat, count(DISTINCT unit) AS n FROM st GROUP BY 1) m ON m.first_treat = c.g) GROUP BY e)"
_SA_MIXED = "SELECT e AS name, list_dot_product(c, b) AS b, sqrt(list_dot_product(c, list_transform(v, lambda r: list_dot_product(r, c)))) AS se, df, CAST(n AS BIGINT) AS n FROM ob, ov, w"
_SA = f"WITH RECURSIVE {_SA_BEFORE}{M.least_squares('o', _SA_ROWS, len(_SA_CELLS))}, {M.covariance('o', len(_SA_CELLS), 'cluster', '30')}, {_SA_W} SELECT CAST(e AS INTEGER) AS e, b AS att, se, stat, p, low, high, n FROM ({M.inference(_SA_MIXED, 5, key='e', more=', n')})"


@query("l8_sun_abraham", _SA)
def _(t):
    return rounded(did.sun_abraham(staggered(t), "y", "unit", "year", "first_treat"), 5)


# dummies of the 25 units and of all years but the first, fitted on untreated rows
_Z = "list_concat(list_transform(range(0, 25), lambda k: CAST(unit = k AS DOUBLE)), list_transform(range(1996, 2001), lambda k: CAST(year = k AS DOUBLE)))"
_FREE = f"""st AS MATERIALIZED (SELECT *, {_Z} AS x FROM {_ST}), {M.least_squares('f', 'SELECT y, x, unit FROM st WHERE treated = 0', 30)},
rest AS MATERIALIZED (SELECT st.unit, st.year, treated, first_treat, st.x, y - list_dot_product(x, b) AS r FROM st, fb)"""
_BJS = f"""WITH RECURSIVE {_FREE}, n AS (SELECT count(*) AS n, avg(r) AS att FROM rest WHERE treated = 1),
need AS MATERIALIZED ({M.vector('(SELECT x FROM rest WHERE treated = 1)', 30, 'x[i]')}),
a AS (SELECT list_transform(inv, lambda r: list_dot_product(r, v)) AS a FROM fb, need),
fi AS (SELECT unit, fsum(CASE WHEN treated = 1 THEN r - m ELSE -list_dot_product(x, a) * r END / n) AS f FROM (SELECT *, avg(r) OVER (PARTITION BY first_treat, year, treated) AS m FROM rest), a, n GROUP BY unit)
SELECT CAST(name AS INTEGER) AS key, b AS att, se, stat, p, low, high, n FROM ({M.inference('SELECT 0 AS name, att AS b, se, CAST(NULL AS DOUBLE) AS df, n FROM n, (SELECT sqrt(fsum(f * f)) AS se FROM fi)', 6, more=', n')})"""


@query("l9_imputation", _BJS)
def _(t):
    return rounded(did.imputation(staggered(t), "y", "treated", "unit", "year"), 6)


@query("l10_gardner", M.regression("SELECT r AS y, [treated]::DOUBLE[] AS x, unit AS cl FROM rest", ["d"], 6, "cluster", before=_FREE + ", "))
def _(t):
    return rounded(did.gardner(staggered(t), "y", "treated", "unit", "year").coefficients(t.spark), 6)


_STACK = f"""sr AS MATERIALIZED (SELECT unit, year, stack, y, CAST(first_treat = stack AND year >= stack AS DOUBLE) AS d FROM {_ST}, (VALUES (1997), (1998), (1999)) s(stack) WHERE (first_treat = stack OR first_treat = 0 OR first_treat > stack + 1) AND year BETWEEN stack - 2 AND stack + 1),
sd AS MATERIALIZED (SELECT y - avg(y) OVER u - avg(y) OVER t + avg(y) OVER a AS y, d - avg(d) OVER u - avg(d) OVER t + avg(d) OVER a AS d FROM sr WINDOW u AS (PARTITION BY stack, unit), t AS (PARTITION BY stack, year), a AS (PARTITION BY stack)), """
_STACK_DF = "(SELECT count(DISTINCT (stack, unit)) + count(DISTINCT (stack, year)) - 1 FROM sr)"


@query("l11_stacked", M.regression("SELECT y, [d]::DOUBLE[] AS x FROM sd", ["d"], 6, df_used=_STACK_DF, before=_STACK))
def _(t):
    return rounded(did.stacked(staggered(t), "y", "unit", "year", "first_treat", (-2, 1)).coefficients(t.spark), 6)


_GAPS = f"SELECT year, avg(y) FILTER (ever = 1) - avg(y) FILTER (ever = 0) AS gap, var_samp(y) FILTER (ever = 1) / count(*) FILTER (ever = 1) + var_samp(y) FILTER (ever = 0) / count(*) FILTER (ever = 0) AS var FROM {_ST} GROUP BY year"


@query("l12_event_study", f"SELECT CAST(g.year AS INTEGER) AS period, round(g.gap - r.gap, 7) AS effect, CASE WHEN g.year = 1996 THEN 0 ELSE round(sqrt(g.var + r.var), 7) END AS se FROM ({_GAPS}) g, ({_GAPS}) r WHERE r.year = 1996")
def _(t):
    out = did.event_study(staggered(t), "y", "ever", "year", 1996)
    return out.select(c("period").cast("int").alias("period"), rnd("effect", 7).alias("effect"), rnd("se", 7).alias("se"))


# pairs of cohorts, the years before and after in which they are compared, and their weights
_BACON = f"""WITH st AS MATERIALIZED (SELECT * FROM {_ST}), n AS (SELECT first_treat AS g, count(*) * 1.0 / (SELECT count(*) FROM st) AS s, avg(treated) AS d FROM st GROUP BY 1),
p AS (SELECT k.g AS k, c.g AS c, k.s + c.s AS n, k.s / (k.s + c.s) AS f, k.d AS dk, c.d AS dc FROM n k JOIN n c ON k.g <> c.g AND k.g > 0),
m AS (SELECT k, c, avg(y) FILTER (first_treat = k AND post) - avg(y) FILTER (first_treat = k AND NOT post) - avg(y) FILTER (first_treat = c AND post) + avg(y) FILTER (first_treat = c AND NOT post) AS e FROM (SELECT *, year >= k AS post FROM p JOIN st ON first_treat IN (k, c) AND (c = 0 OR (k < c AND year < c) OR (k > c AND year >= c))) GROUP BY k, c),
w AS (SELECT k, c, CASE WHEN c = 0 THEN 'treated vs never' WHEN k < c THEN 'earlier vs later' ELSE 'later vs earlier' END AS kind, f * (1 - f) * n * n * CASE WHEN c = 0 THEN dk * (1 - dk) WHEN k < c THEN (dk - dc) * (1 - dk) ELSE dk * (dc - dk) END AS w FROM p)
SELECT kind, CAST(k AS INTEGER) AS treated, CAST(c AS INTEGER) AS control, round(e, 7) AS estimate, round(w / sum(w) OVER (), 7) AS weight FROM m JOIN w USING (k, c)"""


@query("l13_bacon", _BACON)
def _(t):
    return rounded(did.bacon(staggered(t), "y", "unit", "year", "first_treat"), 7)


_DIFF = f"""df AS MATERIALIZED (SELECT cust, year, spent - lag(spent) OVER w AS y, n - lag(n) OVER w AS n FROM {_CY} WINDOW w AS (PARTITION BY cust ORDER BY year)),
fd AS (SELECT fsum(n * y) / fsum(n * n) AS b FROM df),
la AS MATERIALIZED (SELECT * FROM (SELECT cust, e, lag(e) OVER (PARTITION BY cust ORDER BY year) AS l FROM (SELECT cust, year, y - b * n AS e FROM df, fd WHERE y IS NOT NULL)) WHERE l IS NOT NULL), """
_RHO = M.least_squares("o", "SELECT e / 1e5 AS y, [l / 1e5]::DOUBLE[] AS x, cust AS cl FROM la", 1) + ", " + M.covariance("o", 1, "cluster")
_RHO_T = "SELECT 'rho' AS name, b[1] + 0.5 AS b, sqrt(v[1][1]) AS se, (SELECT count(DISTINCT cust) - 1.0 FROM la)::DOUBLE AS df FROM ob, ov"


@query("k12_xtserial", f"WITH RECURSIVE {_DIFF}{_RHO}, t AS ({_RHO_T}) SELECT round(any_value(t.b) - 0.5, 6) AS rho, round(any_value(t.b * t.b / t.se / t.se), 4) AS f, 1.0 AS df1, any_value(t.df) AS df2, any_value(i.p) AS p FROM t, ({M.inference('SELECT * FROM t', 6)}) i")
def _(t):
    return rounded(post.xtserial(cust_year(t), "spent", ["n"], "cust", "year"), 6).withColumn("f", rnd("f"))
