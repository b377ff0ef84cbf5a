"""Estimates and diagnostics on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..estimate import linear, mle, post
from ..estimate.fit import predict
from . import models_sql as M
from . import query, rnd

c = F.col
XS = ["l_quantity", "l_discount", "l_tax"]


def rounded(df, digits):
    return df.withColumns({n: rnd(n, digits) for n, kind in df.dtypes if kind == "double"})


def _coef(t, fit, digits=6, **kw):
    return rounded(fit.coefficients(t.spark, **kw), digits)


_X = "[l_quantity, l_discount, l_tax, 1]::DOUBLE[]"
_LINES = f"SELECT l_extendedprice AS y, {_X} AS x, l_suppkey AS cl FROM lineitem"
_NAMES = [*XS, "_cons"]
_FLAGS = "[l_quantity, l_discount, l_tax, CAST(l_returnflag = 'N' AS INTEGER), CAST(l_returnflag = 'R' AS INTEGER), 1]::DOUBLE[]"
_RETURNED = f"SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, {_X} AS x, 1.0 AS w FROM lineitem"
_LOGIT = "SELECT x, w * (y - p) AS s, w * p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM {r})"
_SCORES = ("s * x[i]", "h * x[i] * x[j]")


def _signed(t):
    return t.lineitem.select(*XS, "l_extendedprice", "l_suppkey", "l_linenumber", (c("l_returnflag") == "R").cast("int").alias("returned"))


def _counts(t):
    """Orders with their number of lines, and the log price."""
    n = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.avg("l_discount").alias("disc"))
    return t.orders.join(n, "o_orderkey").select("o_orderkey", "n_lines", "disc", F.ln("o_totalprice").alias("lprice"), "o_totalprice")


_SIMPLE = "SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem"


@query("j1_ols_simple", f"SELECT round(b, 5) AS slope, round(a, 3) AS intercept, round(r2, 8) AS r2 FROM ({_SIMPLE})")
def _(t):
    fit = linear.ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    row = (fit["l_quantity"], fit["_cons"], float(fit.stats["r2"]))
    return t.spark.createDataFrame([row], "slope double, intercept double, r2 double").select(rnd("slope", 5).alias("slope"), rnd("intercept", 3).alias("intercept"), rnd("r2", 8).alias("r2"))


@query("j1_ols", M.regression(f"SELECT l_extendedprice AS y, {_FLAGS} AS x FROM lineitem", [*XS, "N.l_returnflag", "R.l_returnflag", "_cons"], 3))
def _(t):
    return _coef(t, linear.ols(t.lineitem, "l_extendedprice", XS, factors=["l_returnflag"]), 3)


_WITHIN = "la AS MATERIALIZED (SELECT l_partkey, l_extendedprice - avg(l_extendedprice) OVER p AS y, [l_quantity - avg(l_quantity) OVER p, l_discount - avg(l_discount) OVER p, l_tax - avg(l_tax) OVER p]::DOUBLE[] AS x, l_suppkey AS cl FROM lineitem WINDOW p AS (PARTITION BY l_partkey)), "


@query("j1_ols_levels", M.regression("SELECT y, x, cl FROM la", XS, 2, "cluster", df_used="(SELECT count(DISTINCT l_partkey) FROM la)", before=_WITHIN))
def _(t):
    """A dummy a part."""
    fit = linear.ols(t.lineitem, "l_extendedprice", XS, factors=["l_partkey"], vcov=("cluster", "l_suppkey"))
    return _coef(t, fit, 2).filter(c("name").isin(XS))


@query("j2_ols_hc1", M.regression(_LINES, _NAMES, 3, "hc1"))
def _(t):
    return _coef(t, linear.ols(t.lineitem, "l_extendedprice", XS, vcov="hc1"), 3)


@query("j3_ols_cluster", M.regression(_LINES, _NAMES, 3, "cluster"))
def _(t):
    return _coef(t, linear.ols(t.lineitem, "l_extendedprice", XS, vcov=("cluster", "l_suppkey")), 3)


# rows over the root of their weight: analytic weights by plain least squares
_WEIGHTED = "SELECT l_extendedprice * sqrt(l_quantity) AS y, [l_discount * sqrt(l_quantity), sqrt(l_quantity)]::DOUBLE[] AS x FROM lineitem"


@query("j4_wls", M.regression(_WEIGHTED, ["l_discount", "_cons"], 3))
def _(t):
    return _coef(t, linear.ols(t.lineitem, "l_extendedprice", ["l_discount"], weight="l_quantity", wtype="aweight"), 3)


@query("j5_logit", M.likelihood(_RETURNED, 4, "[0, 0, 0, 0]::DOUBLE[]", _LOGIT, *_SCORES) + " " + M.inference(M.effects("o", M.units(*_NAMES)), 6, exponentiate=True))
def _(t):
    return _coef(t, mle.logit(_signed(t), "returned", XS), exponentiate=True)


_PROBIT = f"SELECT x, q * f / c AS s, f / c * (f / c + q * xb) AS h FROM (SELECT *, {M.cdf('q * xb')} AS c, {M.PDF.format('xb')} AS f FROM (SELECT x, 2 * y - 1 AS q, list_dot_product(x, b) AS xb FROM {{r}}))"


@query("j6_probit", M.likelihood(_RETURNED, 4, "[0, 0, 0, 0]::DOUBLE[]", _PROBIT, *_SCORES) + " " + M.inference(M.effects("o", M.units(*_NAMES)), 6))
def _(t):
    return _coef(t, mle.probit(_signed(t), "returned", XS))


_COUNTS = "SELECT n_lines AS y, [ln(o_totalprice), disc, 1]::DOUBLE[] AS x, ln(o_totalprice) AS o FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, avg(l_discount) AS disc FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
_POISSON = "SELECT x, y - mu AS s, mu AS h FROM (SELECT *, exp(list_dot_product(x, b) + o) AS mu FROM {r})"


@query("j7_poisson", M.likelihood(_COUNTS, 3, "[0, 0, ln(sum(y) / sum(exp(o)))]::DOUBLE[]", _POISSON, *_SCORES, rounds=10) + " " + M.inference(M.effects("o", M.units("lprice", "disc", "_cons")), 6))
def _(t):
    return _coef(t, mle.poisson(_counts(t), "n_lines", ["lprice", "disc"], exposure="o_totalprice"))


@query("j8_weighted_glm", M.likelihood("SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, [l_discount, l_tax, 1]::DOUBLE[] AS x, l_quantity AS w FROM lineitem", 3, "[0, 0, 0]::DOUBLE[]", _LOGIT, *_SCORES) + " " + M.inference(M.effects("o", M.units("l_discount", "l_tax", "_cons")), 6))
def _(t):
    return _coef(t, mle.logit(_signed(t), "returned", ["l_discount", "l_tax"], weight="l_quantity", wtype="fweight"))


# lines a customer vary more than Poisson counts
_BUSY = "SELECT n_lines AS y, [c_acctbal / 10000, 1]::DOUBLE[] AS x FROM customer JOIN (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey"
# a row's score s by the linear predictor, its information h, their cross c with ln(alpha), and the first two derivatives by it
_NB = "SELECT x, (y - mu) / den AS s, mu * (1 + a * y) / den ** 2 AS h, (y - mu) * a * mu / den ** 2 AS c, up + rate - (1 + a * y) * mu / den AS gl, up2 + mu / den - rate - a * mu * (y - mu) / den ** 2 AS hl FROM (SELECT *, ln(den) / a AS rate, coalesce(list_sum(list_transform(range(0, y), lambda q: a * q / (1 + a * q))), 0) AS up, coalesce(list_sum(list_transform(range(0, y), lambda q: a * q / (1 + a * q) ** 2)), 0) AS up2 FROM (SELECT *, 1 + a * mu AS den FROM (SELECT x, y, exp(b[3]) AS a, exp(list_dot_product(x, b[1:2])) AS mu FROM {r})))"
_NB_G = "CASE WHEN i < 3 THEN x[i] * s ELSE gl END"
_NB_H = "CASE WHEN i < 3 AND j < 3 THEN x[i] * x[j] * h WHEN i = 3 AND j = 3 THEN -hl ELSE x[least(i, j)] * c END"


@query("j9_nbreg", M.likelihood(_BUSY, 3, "[0, ln(avg(y)), ln((var_samp(y) - avg(y)) / avg(y) ** 2)]::DOUBLE[]", _NB, _NB_G, _NB_H) + " " + M.inference(M.effects("o", M.units("balance", "_cons", "ln_alpha")), 5))
def _(t):
    lines = t.orders.join(t.lineitem.select("l_orderkey"), c("o_orderkey") == c("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n_lines"))
    df = t.customer.join(lines, c("o_custkey") == c("c_custkey")).select("n_lines", (c("c_acctbal") / 10000).alias("balance"))
    fit = mle.nbreg(df, "n_lines", ["balance"])
    alpha = fit._row("ln_alpha", fit.stats["ln_alpha"], fit.stats["ln_alpha_se"] ** 2, 95)
    both = fit.coefficients(t.spark)
    return rounded(both.unionByName(t.spark.createDataFrame([alpha], both.schema)), 5)


# a row's residual over sigma r, its score g by the mean and its curvature h; m: not censored
_TOBIT = f"SELECT list_append(x, 1) AS x, s, r, m, CASE WHEN m = 1 THEN r ELSE -f / c END AS g, CASE WHEN m = 1 THEN 1 ELSE f / c * (r + f / c) END AS h FROM (SELECT *, CASE WHEN m = 0 THEN {M.cdf('r')} END AS c, {M.PDF.format('r')} AS f FROM (SELECT x, exp(b[3]) AS s, (y - list_dot_product(x, b[1:2])) / exp(b[3]) AS r, CAST(y > 0 AS INTEGER) AS m FROM {{r}}))"
_TOBIT_G = "CASE WHEN i < 3 THEN x[i] * g / s ELSE g * r - m END"
_TOBIT_H = "CASE WHEN i < 3 AND j < 3 THEN x[i] * x[j] * h / (s * s) WHEN i = 3 AND j = 3 THEN h * r * r + g * r ELSE x[i] * x[j] * (h * r + g) / s END"


@query("j10_tobit", M.likelihood("SELECT greatest(c_acctbal, 0) AS y, [c_nationkey, 1]::DOUBLE[] AS x FROM customer", 3, "[regr_slope(y, x[1]), regr_intercept(y, x[1]), ln(stddev_samp(y))]::DOUBLE[]", _TOBIT, _TOBIT_G, _TOBIT_H) + " " + M.inference(M.effects("o", {"c_nationkey": [1, 0, 0], "_cons": [0, 1, 0]}), 4))
def _(t):
    return _coef(t, mle.tobit(t.customer.select(F.greatest("c_acctbal", F.lit(0.0)).alias("bal"), "c_nationkey"), "bal", ["c_nationkey"], ll=0.0), 4)


# one instrument: covariances give the slope and its error; the mean residual is zero
_IV = "SELECT z, x, y, sum(z * y) OVER () / sum(z * x) OVER () AS b FROM (SELECT l_tax - avg(l_tax) OVER () AS z, l_discount - avg(l_discount) OVER () AS x, l_extendedprice - avg(l_extendedprice) OVER () AS y FROM lineitem)"


@query("j11_iv2sls", f"SELECT round(any_value(b), 2) AS b, round(sqrt(sum((y - b * x) ** 2) / count(*) * sum(z * z)) / abs(sum(z * x)), 2) AS se FROM ({_IV})")
def _(t):
    fit = linear.iv2sls(t.lineitem, "l_extendedprice", [], ["l_discount"], ["l_tax"])
    return rounded(fit.coefficients(t.spark).filter("name = 'l_discount'").select("b", "se"), 2)


_E = f"SELECT *, l_extendedprice - a - b * l_quantity AS e, l_quantity - avg(l_quantity) OVER () AS dx FROM lineitem, ({_SIMPLE})"


def _slope_se(t, fit):
    return t.spark.createDataFrame([(fit["l_quantity"], fit.se("l_quantity"))], "slope double, se double").select(rnd("slope", 5).alias("slope"), rnd("se", 6).alias("se"))


@query("j1_ols_se", f"SELECT round(any_value(b), 5) AS slope, round(sqrt(sum(e * e) / (count(*) - 2) / sum(dx * dx)), 6) AS se FROM ({_E})")
def _(t):
    return _slope_se(t, linear.ols(t.lineitem, "l_extendedprice", ["l_quantity"]))


@query("j2_hc1_se", f"SELECT round(any_value(b), 5) AS slope, round(sqrt(sum(dx * dx * e * e) * count(*) / (count(*) - 2)) / sum(dx * dx), 6) AS se FROM ({_E})")
def _(t):
    return _slope_se(t, linear.ols(t.lineitem, "l_extendedprice", ["l_quantity"], vcov="hc1"))


@query("j3_cluster_se", f"SELECT round(any_value(b), 5) AS slope, round(sqrt(sum(u * u) * count(*) / (count(*) - 1) * (sum(n) - 1) / (sum(n) - 2)) / sum(xx), 6) AS se FROM (SELECT l_suppkey, any_value(b) AS b, sum(dx * e) AS u, sum(dx * dx) AS xx, count(*) AS n FROM ({_E}) GROUP BY l_suppkey)")
def _(t):
    return _slope_se(t, linear.ols(t.lineitem, "l_extendedprice", ["l_quantity"], vcov=("cluster", "l_suppkey")))


def _score(df, fit, y, mean):
    """Sums of each term over the counted and over the fitted values, which the score
    equations make equal."""
    sums = df.agg(*(F.sum(v * x.value()).alias(f"{n}{j}") for j, x in enumerate(fit.terms) for n, v in (("seen", c(y)), ("fitted", mean(fit.xb())))))
    each = [F.struct(F.lit(x.name).alias("term"), rnd(f"seen{j}", 3).alias("seen"), rnd(f"fitted{j}", 3).alias("fitted")) for j, x in enumerate(fit.terms)]
    return sums.select(F.inline(F.array(*each)))


def _score_sql(rows, names):
    each = ", ".join(f"('{n}', {j + 1})" for j, n in enumerate(names))
    return f"SELECT term, round(sum(x[i] * y), 3) AS seen, round(sum(x[i] * y), 3) AS fitted FROM ({rows}), (VALUES {each}) v(term, i) GROUP BY term"


@query("j5_logit_score", _score_sql(_RETURNED, _NAMES))
def _(t):
    df = _signed(t)
    return _score(df, mle.logit(df, "returned", XS), "returned", lambda xb: 1 / (1 + F.exp(-xb)))


@query("j7_poisson_score", _score_sql(_COUNTS, ["lprice", "disc", "_cons"]))
def _(t):
    df = _counts(t)
    return _score(df, mle.poisson(df, "n_lines", ["lprice", "disc"]), "n_lines", F.exp)


@query("j12_design", "SELECT c_mktsegment || '.c_mktsegment' AS term, CAST(count(*) AS DOUBLE) AS total FROM customer WHERE c_mktsegment > (SELECT min(c_mktsegment) FROM customer) GROUP BY 1 UNION ALL SELECT 'c_acctbal', round(sum(c_acctbal), 2) FROM customer UNION ALL SELECT '_cons', count(*) FROM customer")
def _(t):
    """Column sums of the design matrix."""
    from ..estimate.design import terms_of

    terms = terms_of(t.customer, ["c_acctbal"], ["c_mktsegment"])
    wide = t.customer.agg(*(rnd(F.sum(x.value()), 2).alias(f"s{j}") for j, x in enumerate(terms)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(x.name).alias("term"), c(f"s{j}").alias("total")) for j, x in enumerate(terms)))))


@query("k1_predict", f"SELECT l_orderkey, round(a + b * l_quantity, 2) AS yhat, round(l_extendedprice - a - b * l_quantity, 2) AS e FROM lineitem, ({_SIMPLE})")
def _(t):
    fit = linear.ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    out = predict(predict(t.lineitem, fit, "yhat"), fit, "e", "residuals")
    return out.select("l_orderkey", rnd("yhat", 2).alias("yhat"), rnd("e", 2).alias("e"))


@query("k2_contrasts", M.regression(_LINES, _NAMES, 3, targets={"discount = tax": [0, 1, -1, 0], "discount + 2 tax": [0, 1, 2, 0]}))
def _(t):
    fit = linear.ols(t.lineitem, "l_extendedprice", XS)
    return _coef(t, fit, 3, contrasts={"discount = tax": {"l_discount": 1, "l_tax": -1}, "discount + 2 tax": {"l_discount": 1, "l_tax": 2}})


_EFFECTS = """, f AS MATERIALIZED (SELECT x, p * (1 - p) AS d1, p * (1 - p) * (1 - 2 * p) AS d2 FROM (SELECT x, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM d, ob)),
a AS MATERIALIZED (SELECT avg(d1) AS d1, [avg(d2 * x[1]), avg(d2 * x[2]), avg(d2 * x[3]), avg(d2 * x[4])] AS d2 FROM f),
gr AS (SELECT name, d1 * b[n] AS b, list_transform(range(1, 5), lambda i: b[n] * d2[i] + CASE WHEN i = n THEN d1 ELSE 0 END) AS g FROM a, ob, (VALUES ('l_quantity', 1), ('l_discount', 2), ('l_tax', 3)) z(name, n)) """
_MARGINS = "SELECT name, b, sqrt(list_dot_product(g, list_transform(v, lambda r: list_dot_product(r, g)))) AS se, df FROM gr, ov"


@query("k4_margins", M.likelihood(_RETURNED, 4, "[0, 0, 0, 0]::DOUBLE[]", _LOGIT, *_SCORES) + _EFFECTS + f"SELECT name, b AS margin, se, stat, p, low, high, 'average' AS kind FROM ({M.inference(_MARGINS, 6)})")
def _(t):
    df = _signed(t)
    return rounded(post.margins(df, mle.logit(df, "returned", XS), dydx=XS), 6)


@query("k5_vif", "SELECT 'l_discount' AS variable, round(1 / (1 - power(corr(l_discount, l_tax), 2)), 8) AS vif FROM lineitem UNION ALL SELECT 'l_tax', round(1 / (1 - power(corr(l_discount, l_tax), 2)), 8) FROM lineitem")
def _(t):
    return post.vif(t.lineitem, ["l_discount", "l_tax"]).withColumn("vif", rnd("vif", 8))


def _fit(t):
    return linear.ols(t.lineitem, "l_extendedprice", XS)


@query("k6_hettest", "SELECT round(count(*) * regr_r2(e * e, l_quantity), 4) AS chi2, 1.0 AS df FROM (SELECT l_quantity, l_extendedprice - a - b * l_quantity AS e FROM lineitem, (" + _SIMPLE + "))")
def _(t):
    fit = linear.ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    return post.hettest(t.lineitem, fit).select(rnd("chi2").alias("chi2"), "df")


# the auxiliary columns are centred and scaled, which spans the same space
_WHITE = "SELECT e * e / 1e9 AS y, [a, b, c, a * a, b * b, c * c, a * b, a * c, b * c, 1]::DOUBLE[] AS x FROM (SELECT e, (x[1] - 25) / 15 AS a, (x[2] - 0.05) / 0.03 AS b, (x[3] - 0.04) / 0.03 AS c FROM oe)"
_CHI2_9 = "exp(3.5 * ln(greatest(u, 1e-300)) - u / 2 - 4.5 * ln(2) - lgamma(4.5))"


@query("k7_white", f"WITH RECURSIVE {M.least_squares('o', _LINES, 4)}, {M.least_squares('w', _WHITE, 10)}, c AS MATERIALIZED (SELECT count(*) * (1 - fsum(e * e) / (count(*) * var_pop(y))) AS chi2 FROM we) SELECT round(chi2, 4) AS chi2, 9.0 AS df, round(1 - {M.simpson(_CHI2_9, 'SELECT chi2 FROM c')}, 4) AS p FROM c")
def _(t):
    return rounded(post.white(t.lineitem, _fit(t)), 4)


# R2 of two regressors from three correlations
_R2 = "(r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12)"


@query("k7_white_one", f"SELECT round(n * {_R2}, 4) AS chi2, 2.0 AS df FROM (SELECT count(*) AS n, corr(e * e, dx) AS r1, corr(e * e, dx * dx) AS r2, corr(dx, dx * dx) AS r12 FROM ({_E}))")
def _(t):
    fit = linear.ols(t.lineitem, "l_extendedprice", ["l_quantity"])
    return post.white(t.lineitem, fit).select(rnd("chi2").alias("chi2"), "df")


_ORD = "SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders"


_LAGS = "SELECT e / 1e5 AS y, [x / 1e3, coalesce(lag(e) OVER (ORDER BY o_orderkey), 0) / 1e5, coalesce(lag(e, 2) OVER (ORDER BY o_orderkey), 0) / 1e5, 1]::DOUBLE[] AS x FROM (SELECT o_orderkey, o_custkey AS x, o_totalprice - a - b * o_custkey AS e FROM orders, (" + _ORD + "))"


@query("k8_bgodfrey", f"SELECT round(chi2, 5) AS chi2, 2.0 AS df, round(exp(-chi2 / 2), 5) AS p FROM (WITH RECURSIVE {M.least_squares('o', _LAGS, 4)} SELECT count(*) * (1 - fsum(e * e) / (count(*) * var_pop(y))) AS chi2 FROM oe)")
def _(t):
    fit = linear.ols(t.orders, "o_totalprice", ["o_custkey"])
    return rounded(post.breusch_godfrey(t.orders, fit, ["o_orderkey"], 2), 5)


@query("k8_bgodfrey_one", f"SELECT round(n * {_R2}, 5) AS chi2, 1.0 AS df FROM (SELECT count(*) AS n, corr(e, x) AS r1, corr(e, l) AS r2, corr(x, l) AS r12 FROM (SELECT e, x, coalesce(lag(e) OVER (ORDER BY o_orderkey), 0) AS l FROM (SELECT o_orderkey, o_custkey AS x, o_totalprice - a - b * o_custkey AS e FROM orders, ({_ORD}))))")
def _(t):
    fit = linear.ols(t.orders, "o_totalprice", ["o_custkey"])
    return post.breusch_godfrey(t.orders, fit, ["o_orderkey"], 1).select(rnd("chi2", 5).alias("chi2"), "df")


_POWERS = "SELECT y, list_concat(x, [h * h, h * h * h]) AS x FROM (SELECT y, x, (y - e - avg(y - e) OVER ()) / stddev_samp(y - e) OVER () AS h FROM oe)"


@query("k9_ovtest", f"WITH RECURSIVE {M.least_squares('o', _LINES, 4)}, {M.least_squares('w', _POWERS, 6)}, c AS (SELECT (small - big) / 2 / (big / df2) AS f, CAST(df2 AS DOUBLE) AS df2 FROM (SELECT fsum(e * e) AS small FROM oe), (SELECT fsum(e * e) AS big, count(*) - 6 AS df2 FROM we)) SELECT round(f, 5) AS f, 2.0 AS df1, df2, round(exp(-df2 / 2 * ln(1 + 2 * f / df2)), 5) AS p FROM c")
def _(t):
    return rounded(post.reset(t.lineitem, _fit(t)), 5)


@query("k10_dwatson", f"SELECT round(sum(power(e - l, 2)) / sum(e * e), 8) AS dw FROM (SELECT e, lag(e) OVER (ORDER BY o_orderkey) AS l FROM (SELECT o_orderkey, o_totalprice - a - b * o_custkey AS e FROM orders, ({_ORD})))")
def _(t):
    fit = linear.ols(t.orders, "o_totalprice", ["o_custkey"])
    return post.durbin_watson(t.orders, fit, ["o_orderkey"]).select(rnd("dw", 8).alias("dw"))


@query("k11_sample_summary", " UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS sd, CAST(min({v}) AS DOUBLE) AS min, CAST(max({v}) AS DOUBLE) AS max FROM orders" for v in ("o_totalprice", "o_custkey")))
def _(t):
    fit = linear.ols(t.orders, "o_totalprice", ["o_custkey"])
    out = post.sample_summary(t.orders, fit)
    return out.withColumns({"mean": rnd("mean"), "sd": rnd("sd")})
