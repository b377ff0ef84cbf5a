"""Diagnostics and effects after an estimate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import distributions as D
from ..operators.rows import lagged as lagged_rows
from ..operators.rows import number_rows
from .design import Term, design, products, sums
from .fit import Fit
from .linear import ols


def with_residuals(df: DataFrame, fit: Fit, yhat: str = "_yhat", res: str = "_res") -> DataFrame:
    """Complete rows with fitted values and residuals."""
    used = {t.col for t in fit.terms if t.col} | {fit.y}
    return df.dropna(subset=list(used)).withColumn(yhat, fit.xb()).withColumn(res, F.col(fit.y) - F.col(yhat))


def _row(of: DataFrame, /, **values: float) -> DataFrame:
    return of.sparkSession.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """(variable, vif): the diagonal of the inverse correlation matrix."""
    d = design(df, xs[0], xs, constant=True)
    k = len(xs)
    corr = products(d.rows, d.z[:k]) / (d.n - 1)
    inverse = np.linalg.inv(corr)
    return df.sparkSession.createDataFrame([(x, float(inverse[j, j])) for j, x in enumerate(xs)], "variable string, vif double")


def _terms(fit: Fit, *more: str) -> list[Term]:
    """All terms of the fit, factor levels with them, further columns and a constant."""
    own = [t for t in fit.terms if t.col]
    return [*own, *(Term(c, c) for c in more), Term("_cons")]


def _columns(terms: list[Term]) -> list[str]:
    return list(dict.fromkeys(t.col for t in terms if t.col))


def _auxiliary(own: DataFrame, y: str, terms: list[Term]) -> Fit:
    return ols(own, y, _columns(terms), terms=terms)


def hettest(df: DataFrame, fit: Fit) -> DataFrame:
    """Breusch-Pagan: n R2 of squared residuals on the regressors."""
    own = with_residuals(df, fit).withColumn("_e2", F.col("_res") * F.col("_res"))
    aux = _auxiliary(own, "_e2", _terms(fit))
    q = aux.stats["rank"] - 1
    chi2 = aux.n * aux.stats["r2"]
    return _row(df, chi2=chi2, df=q, p=D.chi2_upper(chi2, q))


def white(df: DataFrame, fit: Fit) -> DataFrame:
    """White's test: squares and cross products as well; products that repeat a
    column, as squares of dummies do, count once."""
    own = with_residuals(df, fit).withColumn("_e2", F.col("_res") * F.col("_res"))
    terms = [t for t in fit.terms if t.col]
    own = own.withColumns({f"_t{j}": t.value() for j, t in enumerate(terms)})
    names = [f"_t{j}" for j in range(len(terms))]
    cross = {}
    for i, s in enumerate(terms):
        for j, t in enumerate(terms[: i + 1]):
            if s.level is not None and s.col == t.col:  # a dummy's square, or two levels of a factor
                continue
            cross[f"_t{i}_{j}"] = F.col(f"_t{i}") * F.col(f"_t{j}")
    aux = ols(own.withColumns(cross) if cross else own, "_e2", [*names, *cross])
    q = aux.stats["rank"] - 1
    chi2 = aux.n * aux.stats["r2"]
    return _row(df, chi2=chi2, df=q, p=D.chi2_upper(chi2, int(q)))


def lagged(df: DataFrame, col: str, order_by, lags: int) -> DataFrame:
    """``col`` of the rows before, by a join on the global row number."""
    rows = number_rows(df, order_by, "_n")
    for k in range(1, lags + 1):
        before = rows.select((F.col("_n") + k).alias("_n"), F.col(col).alias(f"_lag{k}"))
        rows = rows.join(before, "_n", "left")
    return rows


def durbin_watson(df: DataFrame, fit: Fit, order_by) -> DataFrame:
    own = lagged(with_residuals(df, fit), "_res", order_by, 1)
    d = F.col("_res") - F.col("_lag1")
    return own.agg((F.sum(d * d) / F.sum(F.col("_res") * F.col("_res"))).alias("dw"))


def breusch_godfrey(df: DataFrame, fit: Fit, order_by, lags: int = 1) -> DataFrame:
    own = lagged(with_residuals(df, fit), "_res", order_by, lags)
    own = own.fillna(0.0, [f"_lag{k}" for k in range(1, lags + 1)])
    aux = _auxiliary(own, "_res", _terms(fit, *(f"_lag{k}" for k in range(1, lags + 1))))
    chi2 = aux.n * aux.stats["r2"]
    return _row(df, chi2=chi2, df=lags, p=D.chi2_upper(chi2, lags))


def reset(df: DataFrame, fit: Fit) -> DataFrame:
    """Ramsey's test with the second and third power of the fit."""
    own = with_residuals(df, fit)
    stats = own.agg(F.avg("_yhat"), F.stddev_samp("_yhat")).first()
    centre = float(stats[0]) if any(t.col is None for t in fit.terms) else 0.0
    h = (F.col("_yhat") - centre) / float(stats[1] or 1)  # the same span, better conditioned
    own = own.withColumns({"_p2": h * h, "_p3": h * h * h})
    terms = [t for t in fit.terms if t.col]
    cons = [Term("_cons")] if len(terms) < len(fit.terms) else []
    powers = [Term("_p2", "_p2"), Term("_p3", "_p3")]
    big = ols(own, fit.y, _columns([*terms, *powers]), terms=[*terms, *powers, *cons])
    small = ols(own, fit.y, _columns(terms), terms=[*terms, *cons])
    d2 = big.stats["df_resid"]
    f = (small.stats["rss"] - big.stats["rss"]) / 2 / (big.stats["rss"] / d2)
    return _row(df, f=f, df1=2, df2=d2, p=D.f_upper(f, 2, d2))


def sample_summary(df: DataFrame, fit: Fit) -> DataFrame:
    from ..operators.summary import summarize

    used = [fit.y, *(t.col for t in fit.terms if t.col)]
    return summarize(df.dropna(subset=used), *dict.fromkeys(used))


def xtserial(df: DataFrame, y: str, xs: list[str], panel: str, time: str) -> DataFrame:
    """Wooldridge's test: residuals of the differenced model on their lag, H0 -0.5."""
    own = df.select(*dict.fromkeys([panel, time, y, *xs]))
    lag = lagged_rows(own, {f"_earlier_{c}": c for c in (y, *xs)}, [panel], [time])
    diff = lag.select(panel, time, *((F.col(c) - F.col(f"_earlier_{c}")).alias(c) for c in (y, *xs)))
    first = ols(diff, y, xs, constant=False)
    own = lagged_rows(with_residuals(diff, first), {"_before": "_res"}, [panel], [time])
    fit = ols(own, "_res", ["_before"], vcov=("cluster", panel), constant=False)
    t = (fit["_before"] + 0.5) / fit.se("_before")
    groups = own.filter("_before IS NOT NULL").select(panel).distinct().count()
    return _row(df, rho=fit["_before"], f=t * t, df1=1, df2=groups - 1, p=D.f_upper(t * t, 1, groups - 1))


def _mean_function(kind: str) -> tuple:
    """(prediction, its first and second derivative) as functions of the linear index."""
    if kind == "logit":
        p = lambda xb: 1 / (1 + F.exp(-xb))
        return p, lambda xb: p(xb) * (1 - p(xb)), lambda xb: p(xb) * (1 - p(xb)) * (1 - 2 * p(xb))
    if kind in ("poisson", "nbreg"):
        return F.exp, F.exp, F.exp
    if kind == "probit":
        # the density needs no error function; the prediction uses a rational form
        density = lambda xb: F.exp(-xb * xb / 2) / float(np.sqrt(2 * np.pi))
        return _normal_cdf, density, lambda xb: -xb * density(xb)
    return (lambda xb: xb), (lambda xb: F.lit(1.0)), (lambda xb: F.lit(0.0))


def _normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, error below 8e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / float(np.sqrt(2 * np.pi)) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def margins(df: DataFrame, fit: Fit, dydx: list[str] | None = None, at: dict[str, float] | None = None, atmeans: bool = False, level: float = 95) -> DataFrame:
    """(name, margin, se, stat, p, low, high, kind): predictions, or with ``dydx``
    average marginal effects, with errors by the delta method.

    ``at`` sets columns; ``atmeans`` takes the means of the design columns, so of a
    factor its shares.  ``dydx`` names columns or terms; a factor's name stands for
    all its levels, whose effect is the change from its base level.
    """
    rows = df.dropna(subset=_columns(fit.terms))
    for c, v in (at or {}).items():
        rows = rows.withColumn(c, F.lit(v))
    z = [f"z{j}" for j in range(len(fit.terms))]
    flat = rows.select(*(t.value().alias(n) for t, n in zip(fit.terms, z, strict=True)))
    if atmeans:
        flat = flat.agg(*(F.avg(n).alias(n) for n in z))
    value, slope, curve = _mean_function(fit.kind)
    index = lambda change={}: sum((change.get(n, F.col(n)) * float(b) for n, b in zip(z, fit.b, strict=False)), F.lit(0.0))  # noqa: B006, E731
    # each effect is (name, its mean, the gradient of its mean by the coefficients)
    wanted: list[tuple[str, Column, list[Column]]] = []
    if dydx is None:
        wanted.append(("_cons", value(index()), [slope(index()) * F.col(n) for n in z]))
    for name in dydx or []:
        for j, t in enumerate(fit.terms):
            if t.col is None or name not in (t.name, t.col):
                continue
            if t.level is None:
                b = float(fit.b[j])
                grad = [curve(index()) * F.col(n) * b + (slope(index()) if k == j else F.lit(0.0)) for k, n in enumerate(z)]
                wanted.append((t.name, slope(index()) * b, grad))
            else:
                off = {n: F.lit(0.0) for n, u in zip(z, fit.terms, strict=True) if u.col == t.col and u.level is not None}
                on = off | {z[j]: F.lit(1.0)}
                grad = [slope(index(on)) * on.get(n, F.col(n)) - slope(index(off)) * off.get(n, F.col(n)) for n in z]
                wanted.append((t.name, value(index(on)) - value(index(off)), grad))
    if dydx and len({n for n in dydx}) and not wanted:
        raise ValueError(f"no term is named {dydx}")
    got = sums(flat.withColumn("_one", F.lit(1.0)), [F.col("_one"), *(e for _, m, g in wanted for e in (m, *g))])
    n, width = got[0], 1 + len(z)
    kind = "linear" if fit.kind in ("ols", "iv2sls", "tobit") else "at means" if atmeans else "average"
    out = []
    for k, (name, _, _) in enumerate(wanted):
        part = got[1 + k * width : 1 + (k + 1) * width] / n
        grad = part[1:]
        v = fit.v[: len(z), : len(z)]
        out.append((*fit._row(name, part[0], float(grad @ v @ grad), level), kind))
    return df.sparkSession.createDataFrame(out, "name string, margin double, se double, stat double, p double, low double, high double, kind string")
