"""Least squares, weighted, robust and clustered; two-stage least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import distributions as D
from .design import Design, ManyLevels, cluster_meat, demean, design, linear, products, terms_of
from .fit import Fit


def _meat(d: Design, e, z: list, vcov, df_resid: float, bread: np.ndarray, dof_scale: float) -> np.ndarray:
    """Sandwich covariance from residuals ``e`` and instruments or columns ``z``."""
    w = F.col("_w")
    if vcov == "hc1":
        m = products(d.rows.withColumn("_m", w * w * e * e), z, "_m") * dof_scale
    else:
        m, g = cluster_meat(d.rows, f"_e_{vcov[1]}", [w * e * F.col(c) for c in z])
        m = m * g / (g - 1) * (d.n - 1) / df_resid
    return bread @ m @ bread


def ols(
    df: DataFrame,
    y: str,
    xs: list[str],
    factors: list[str] = (),
    weight: str | None = None,
    wtype: str = "aweight",
    vcov="classical",
    constant: bool = True,
    df_used: int = 0,
    terms=None,
) -> Fit:
    """``vcov`` is "classical", "hc1" or ("cluster", column); pweights are robust.

    One pass standardises, one sums products; robust covariance takes another.
    A factor of more than ``design.MAX_LEVELS`` levels is swept out (``absorb``).
    """
    if wtype == "pweight" and weight and vcov == "classical":
        vcov = "hc1"
    extras = [vcov[1]] if isinstance(vcov, tuple) else []
    try:
        d = design(df, y, xs, factors, constant, weight, wtype, extras, terms=terms)
    except ManyLevels as large:
        if not constant:
            raise
        return absorb(df, y, xs, large.factor, [f for f in factors if f != large.factor], weight, wtype, vcov)
    fit = ols_of(d, y, vcov, wtype, df_used)
    d.rows.unpersist()
    return fit


def absorb(df: DataFrame, y: str, xs: list[str], factor: str, factors: list[str] = (), weight: str | None = None, wtype: str = "aweight", vcov="classical") -> Fit:
    """Least squares with an intercept for each level of ``factor``, of any number.

    Columns are taken about their means by level, which gives the same coefficients,
    errors and residuals as a dummy a level; levels count as parameters.  The fit has
    neither levels nor a constant: ``level_effects`` has the intercepts.  Rows with a
    null are left out; a column that does not vary within levels gets 0.
    """
    if wtype == "pweight" and weight and vcov == "classical":
        vcov = "hc1"
    group = vcov[1] if isinstance(vcov, tuple) else None
    own = df.dropna(subset=list(dict.fromkeys(c for c in (y, *xs, factor, *factors, weight, group) if c)))
    own = own.filter(F.col(weight) > 0) if weight else own
    terms = terms_of(own, list(xs), list(factors), constant=False)
    names = [f"x{j}" for j in range(len(terms))]
    rows = own.select(
        F.col(factor).alias("_f"), F.col(y).cast("double").alias("_v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        *([F.col(group).alias("_cl")] if group else []), *(t.value().alias(n) for t, n in zip(terms, names, strict=True)),
    )
    n, sw, mean, levels = rows.agg(F.count("*"), F.sum("_w"), F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")), F.count_distinct("_f")).first()
    tss = rows.agg(F.sum(F.col("_w") * (F.col("_v") - float(mean or 0.0)) ** 2)).first()[0] or 0.0
    flat = demean(rows, ["_v", *names], "_f", "_w")
    fit = ols(flat, "_v", names, weight="_w" if weight else None, wtype=wtype, vcov=("cluster", "_cl") if group else vcov, constant=False, df_used=levels)
    tss *= 1.0 if not weight or wtype == "fweight" else n / sw  # as the weights of the fit
    r2 = 1 - fit.stats["rss"] / tss if tss > 0 else float("nan")
    used = sw if weight and wtype == "fweight" else n
    fit.stats |= {"r2_within": fit.stats["r2"], "r2": r2, "adj_r2": 1 - (1 - r2) * (used - 1) / fit.stats["df_resid"], "n_levels": levels}
    fit.kind, fit.y, fit.terms = "absorb", y, terms
    return fit


def level_effects(df: DataFrame, fit: Fit, factor: str, weight: str | None = None) -> DataFrame:
    """(level, effect, n): the intercept of each level of an absorbed factor."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rest = df.select(F.col(factor).alias("level"), w.alias("_w"), (F.col(fit.y) - fit.xb()).alias("_r")).dropna().filter("_w > 0")
    return rest.groupBy("level").agg((F.sum(F.col("_w") * F.col("_r")) / F.sum("_w")).alias("effect"), F.count("*").alias("n"))


def ols_of(d: Design, y: str, vcov="classical", wtype: str = "aweight", df_used: int = 0) -> Fit:
    k = len(d.terms)
    mean = d.rows.agg(F.try_divide(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")), F.sum("_w")).first()
    rows = d.rows.withColumn("_yc", F.col("_y") - float(mean[0] or 0.0))
    m = products(rows, [*d.z, "_yc"])
    xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
    bread = np.linalg.pinv(xx, hermitian=True)
    has_const = any(t.col is None for t in d.terms)
    gamma = bread @ xy
    sw = float(mean[1] or 0)
    if has_const:
        c = next(j for j, t in enumerate(d.terms) if t.col is None)
        gamma[c] += mean[0]
        tss = yy
        rss = float(yy - xy @ (bread @ xy))
    else:  # the products with y itself
        m = products(d.rows, [*d.z, "_y"])
        xy, yy = m[:k, k], m[k, k]
        gamma, tss = bread @ xy, yy
        rss = float(yy - xy @ gamma)
    rank = int(np.linalg.matrix_rank(xx, hermitian=True))
    n_eff = sw if wtype == "fweight" and d.weighted else d.n
    df_resid = n_eff - rank - df_used
    s2 = rss / df_resid
    e = F.col("_y") - linear(d.z, gamma)
    if vcov == "classical":
        v = bread * s2
    else:
        v = _meat(d, e, d.z, vcov, df_resid, bread, n_eff / df_resid)
    b, v = d.back @ gamma, d.back @ v @ d.back.T
    q = rank - has_const
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    stats = {"r2": r2, "adj_r2": 1 - (1 - r2) * (n_eff - has_const) / df_resid, "rmse": float(np.sqrt(max(s2, 0))), "rss": rss, "df_resid": df_resid, "rank": rank}
    if q and rss > 0:
        stats["f"] = (tss - rss) / q / s2
        stats["f_p"] = D.f_upper(stats["f"], q, df_resid)
    return Fit("ols", y, d.terms, b, v, d.n, df_resid if vcov == "classical" else None, stats, d, gamma)


def iv2sls(df: DataFrame, y: str, exog: list[str], endog: list[str], instruments: list[str], vcov="classical") -> Fit:
    """2SLS: one pass over products of [exogenous, endogenous, instruments, y]."""
    extras = [*instruments, *([vcov[1]] if isinstance(vcov, tuple) else [])]
    own = df.dropna(subset=[y, *exog, *endog, *extras])
    zd = design(own, y, [*exog, *endog, *instruments])
    names = [t.name for t in zd.terms]
    x = [names.index(c) for c in [*endog, *exog, "_cons"]]
    z = [names.index(c) for c in [*exog, *instruments, "_cons"]]
    mean = zd.rows.agg(F.avg("_y")).first()[0]
    m = products(zd.rows.withColumn("_yc", F.col("_y") - float(mean)), [*zd.z, "_yc"])
    zz, zx, zy = m[np.ix_(z, z)], m[np.ix_(z, x)], m[z, len(names)]
    pz = np.linalg.solve(zz, zx)
    bread = np.linalg.inv(zx.T @ pz)
    gamma = bread @ (pz.T @ zy)
    gamma[-1] += mean
    full = np.zeros(len(names))
    full[x] = gamma
    e = F.col("_y") - linear(zd.z, full)
    rows = zd.rows.withColumn("_res", e)
    rss = rows.agg(F.sum(F.col("_res") * F.col("_res"))).first()[0]
    if vcov == "classical":
        v = bread * rss / zd.n
    else:
        fitted = [linear([zd.z[j] for j in z], pz[:, i]) for i in range(len(x))]
        proj = rows.select("_res", "_w", *[f.alias(f"h{i}") for i, f in enumerate(fitted)])
        if isinstance(vcov, tuple):
            own = design(own, y, [*exog, *endog, *instruments], extras=[vcov[1]])
            proj = own.rows.select(e.alias("_res"), F.col(f"_e_{vcov[1]}").alias("_g"), *[f.alias(f"h{i}") for i, f in enumerate(fitted)])
            meat, g = cluster_meat(proj, "_g", [F.col("_res") * F.col(f"h{i}") for i in range(len(x))])
            meat = meat * g / (g - 1)
        else:
            meat = products(proj.withColumn("_m", F.col("_res") * F.col("_res")), [f"h{i}" for i in range(len(x))], "_m")
        v = bread @ meat @ bread
    zd.rows.unpersist()
    back = zd.back[np.ix_(x, x)]
    terms = [zd.terms[j] for j in x]
    return Fit("iv2sls", y, terms, back @ gamma, back @ v @ back.T, zd.n, None, {"rss": rss})
