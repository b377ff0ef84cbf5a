"""Maximum likelihood: one distributed sum an iteration, Newton steps on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import distributions as D
from .design import Design, _tri, batch_sums, cluster_meat, design, linear, products, sums
from .fit import Fit

TOL, ROUNDS, FLAT = 1e-10, 100, 5
#: Counts up to which a batch tabulates them in ``nbreg``.
MAX_COUNT = 10_000_000
_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _phi(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.clip(0.5 * (1 + _erf(x / math.sqrt(2))), 1e-15, 1 - 1e-15)


def _logit(xb: Column, y: Column) -> tuple[Column, Column, Column]:
    """(log likelihood, score, information weight) of a row."""
    p = 1 / (1 + F.exp(-xb))
    ll = y * xb - F.when(xb > 0, xb + F.log1p(F.exp(-xb))).otherwise(F.log1p(F.exp(xb)))
    return ll, y - p, p * (1 - p)


def _poisson(xb: Column, y: Column) -> tuple[Column, Column, Column]:
    mu = F.exp(xb)
    return y * xb - mu, y - mu, mu


NATIVE: dict[str, Callable] = {"logit": _logit, "poisson": _poisson}


def _native_step(d: Design, gamma: np.ndarray, family: str) -> tuple[float, np.ndarray, np.ndarray]:
    xb = linear(d.z, gamma) + F.col("_o")
    own = d.rows.withColumn("_xb", xb)
    ll, s, h = NATIVE[family](F.col("_xb"), F.col("_y"))
    own = own.select("_w", *d.z, ll.alias("_ll"), s.alias("_s"), h.alias("_h"))
    k, w = len(d.z), F.col("_w")
    if k > 12:
        hess = products(own.withColumn("_wh", w * F.col("_h")), d.z, "_wh")
        got = sums(own, [w * F.col("_ll"), *(w * F.col("_s") * F.col(c) for c in d.z)])
        return got[0], got[1:], hess
    got = sums(own, [w * F.col("_ll"), *(w * F.col("_s") * F.col(c) for c in d.z), *(w * F.col("_h") * F.col(d.z[i]) * F.col(d.z[j]) for i, j in _tri(k))])
    hess = np.zeros((k, k))
    for (i, j), v in zip(_tri(k), got[1 + k :], strict=True):
        hess[i, j] = hess[j, i] = v
    return got[0], got[1 : 1 + k], hess


def _probit_kernel(x, y, w, o, theta):
    q = 2 * y - 1
    xb = x @ theta + o
    c, f = _cdf(q * xb), _phi(xb)
    lam = q * f / c
    h = lam * (lam + xb)
    return (w * np.log(c)).sum(), (x * (w * lam)[:, None]), x, w * h


def _batch_step(d: Design, theta: np.ndarray, kernel: Callable) -> tuple[float, np.ndarray, np.ndarray]:
    """``kernel(x, y, w, o, theta)`` gives (ll, gradient, information) of a batch."""
    k, m = len(d.z), len(theta)

    def run(b: dict[str, np.ndarray]) -> np.ndarray:
        x = np.column_stack([b[f"z{j}"] for j in range(k)])
        ll, g, h = kernel(x, b["_y"], b["_w"], b["_o"], theta)
        return np.concatenate([[ll], g, np.asarray(h).ravel()])

    got = batch_sums(d.rows.select("_y", "_w", "_o", *d.z), run, 1 + m + m * m)
    return got[0], got[1 : 1 + m], got[1 + m :].reshape(m, m)


def newton(step: Callable, theta: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """(estimate, log likelihood, information); steps are halved while they lose.

    Ends when the estimate settles, or when the likelihood has stood still for
    ``FLAT`` rounds, as with a dispersion that goes to zero; else raises.
    """
    ll, g, h = step(theta)
    still = 0
    for _ in range(rounds):
        move = np.linalg.lstsq(h, g, rcond=None)[0]
        size = 1.0
        while True:
            new = step(theta + size * move)
            if np.isfinite(new[0]) and new[0] >= ll - 1e-9 * abs(ll) or size < 1e-4:
                break
            size /= 2
        theta = theta + size * move
        gain, (ll, g, h) = abs(new[0] - ll), new
        still = still + 1 if gain < TOL * (abs(ll) + TOL) else 0
        if still and np.abs(size * move).max() < 1e-7 or still >= FLAT:
            return theta, ll, h
    raise ArithmeticError(f"no maximum found in {rounds} rounds")


def _finish(d: Design, kind: str, y: str, gamma, ll, info, vcov, scores: list[Column] | None, null_ll: float | None, extra: dict | None = None) -> Fit:
    k = len(d.z)
    bread = np.linalg.inv(info)
    if vcov == "classical" or scores is None:
        v = bread
    elif vcov == "hc1":
        names = [f"u{j}" for j in range(k)]
        own = d.rows.select(*(s.alias(n) for s, n in zip(scores, names, strict=True)), F.lit(1.0).alias("_one"))
        v = bread @ products(own, names, "_one") @ bread
    else:
        m, g = cluster_meat(d.rows, f"_e_{vcov[1]}", scores)
        v = bread @ (m * g / (g - 1)) @ bread
    stats = {"ll": float(ll), **(extra or {})}
    if null_ll is not None:
        q = sum(t.col is not None for t in d.terms)
        stats |= {"ll_null": null_ll, "chi2": 2 * (ll - null_ll), "pseudo_r2": 1 - ll / null_ll if null_ll else float("nan")}
        if q:
            stats["chi2_p"] = D.chi2_upper(max(stats["chi2"], 0), q)
    d.rows.unpersist()
    return Fit(kind, y, d.terms, d.back @ gamma[:k], d.back @ v[:k, :k] @ d.back.T, d.n, None, stats, d, gamma)


def _exposure(exposure: str | None, offset: str | None) -> Column | None:
    if exposure:
        return F.ln(F.col(exposure).cast("double"))
    return F.col(offset) if offset else None


def _fit_native(family, df, y, xs, factors, weight, wtype, vcov, exposure=None, offset=None) -> Fit:
    extras = [*([vcov[1]] if isinstance(vcov, tuple) else []), *([exposure] if exposure else []), *([offset] if offset else [])]
    d = design(df, y, xs, factors, True, weight, wtype, extras, _exposure(exposure, offset))
    gamma, ll, info = newton(lambda g: _native_step(d, g, family), np.zeros(len(d.z)))
    empty = Design(d.rows.withColumn("z0", F.lit(1.0)), [d.terms[-1]], np.eye(1), d.n, d.weighted, np.ones(1))
    _, null_ll, _ = newton(lambda g: _native_step(empty, g, family), np.zeros(1))
    if family == "poisson":  # the part of the log likelihood without parameters
        const = batch_sums(d.rows.select("_y", "_w"), lambda b: np.array([(b["_w"] * _lgamma(b["_y"] + 1)).sum()]), 1)[0]
        ll, null_ll = ll - const, null_ll - const
    _, s, _ = NATIVE[family](linear(d.z, gamma) + F.col("_o"), F.col("_y"))
    return _finish(d, family, y, gamma, ll, info, vcov, [F.col("_w") * s * F.col(c) for c in d.z], null_ll)


def logit(df: DataFrame, y: str, xs: list[str], factors: list[str] = (), weight: str | None = None, wtype: str = "fweight", vcov="classical") -> Fit:
    return _fit_native("logit", df, y, xs, factors, weight, wtype, vcov)


def poisson(df: DataFrame, y: str, xs: list[str], factors: list[str] = (), weight: str | None = None, wtype: str = "fweight", vcov="classical", exposure: str | None = None, offset: str | None = None) -> Fit:
    return _fit_native("poisson", df, y, xs, factors, weight, wtype, vcov, exposure, offset)


def probit(df: DataFrame, y: str, xs: list[str], factors: list[str] = (), weight: str | None = None, wtype: str = "fweight") -> Fit:
    d = design(df, y, xs, factors, True, weight, wtype)

    def kernel(x, y, w, o, theta):
        ll, g, x, h = _probit_kernel(x, y, w, o, theta)
        return ll, g.sum(axis=0), (x * h[:, None]).T @ x

    gamma, ll, info = newton(lambda t: _batch_step(d, t, kernel), np.zeros(len(d.z)))
    share = d.rows.agg(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).first()
    p, n = share[0] / share[1], share[1]
    null_ll = n * (p * math.log(p) + (1 - p) * math.log(1 - p)) if 0 < p < 1 else 0.0
    return _finish(d, "probit", y, gamma, ll, info, "classical", None, null_ll)


def nbreg(df: DataFrame, y: str, xs: list[str], factors: list[str] = (), exposure: str | None = None, offset: str | None = None) -> Fit:
    """NB2 of counts; the last parameter is ln(alpha), reported in the statistics.

    Counts that vary no more than Poisson ones give an alpha near zero."""
    extras = [x for x in (exposure, offset) if x]
    d = design(df, y, xs, factors, extras=extras, offset=_exposure(exposure, offset))
    if not d.rows.filter(f"_y < 0 OR _y > {MAX_COUNT} OR _y <> floor(_y)").isEmpty():
        raise ValueError(f"{y} holds values that are no counts up to {MAX_COUNT}")
    start = newton(lambda g: _native_step(d, g, "poisson"), np.zeros(len(d.z)))[0]

    def kernel(x, y, w, o, theta):
        la = theta[-1]
        a, xb = math.exp(la), x @ theta[:-1] + o
        mu = np.exp(xb)
        den, rate = 1 + a * mu, np.log1p(a * mu) / a
        # ln G(y + 1/a) - ln G(1/a) + y ln a is the sum of ln(1 + a j) over j < y, so a
        # batch needs the weight of the rows above each j; no difference of large terms
        above = w.sum() - np.cumsum(np.bincount(y.astype(np.int64), weights=w))
        aj = a * np.arange(len(above))
        ll = above @ np.log1p(aj) + (w * (y * xb - (1 + a * y) * rate - _lgamma(y + 1))).sum()
        g = x.T @ (w * (y - mu) / den)
        h = (x * (w * mu * (1 + a * y) / den**2)[:, None]).T @ x
        cross = x.T @ (w * (y - mu) * a * mu / den**2)
        g_la = above @ (aj / (1 + aj)) + (w * (rate - (1 + a * y) * mu / den)).sum()
        h_la = above @ (aj / (1 + aj) ** 2) + (w * (mu / den - rate - a * mu * (y - mu) / den**2)).sum()
        m = len(theta)
        info = np.zeros((m, m))
        info[:-1, :-1], info[:-1, -1], info[-1, :-1], info[-1, -1] = h, cross, cross, -h_la
        return ll, np.append(g, g_la), info

    def step(theta):
        ll, g, info = _batch_step(d, theta, kernel)
        if info[-1, -1] <= 0:  # far from the optimum ln(alpha) is not concave: a step of one at most
            info[-1, -1] = max(abs(info[-1, -1]), abs(g[-1]), 1e-12)
        return ll, g, info

    theta, ll, info = newton(step, np.append(start, -0.5))
    v = np.linalg.inv(info)
    fit = _finish(d, "nbreg", y, theta, ll, info, "classical", None, None, {"alpha": math.exp(theta[-1]), "ln_alpha": theta[-1], "ln_alpha_se": math.sqrt(max(v[-1, -1], 0))})
    return fit


def tobit(df: DataFrame, y: str, xs: list[str], factors: list[str] = (), ll: float | None = None, ul: float | None = None) -> Fit:
    """Censored normal regression; parameters are (beta, ln sigma)."""
    d = design(df, y, xs, factors)
    from .linear import ols_of

    base = ols_of(d, y)

    def kernel(x, y, w, o, theta):
        s = math.exp(theta[-1])
        r = (y - x @ theta[:-1]) / s
        low = y <= ll if ll is not None else np.zeros(len(y), bool)
        high = y >= ul if ul is not None else np.zeros(len(y), bool)
        mid = ~(low | high)
        # derivatives in (mean / sigma) = -d/dr, then chain to (beta, ln sigma)
        ln, g, h = np.empty(len(y)), np.empty(len(y)), np.empty(len(y))
        ln[mid] = -0.5 * r[mid] ** 2 - 0.5 * math.log(2 * math.pi) - math.log(s)
        g[mid], h[mid] = r[mid], 1.0
        for at, sign in ((low, 1.0), (high, -1.0)):
            t = sign * r[at]
            c = _cdf(t)
            m = _phi(t) / c
            ln[at], g[at], h[at] = np.log(c), -sign * m, m * (t + m)
        k = x.shape[1]
        grad = np.append(x.T @ (w * g) / s, (w * (g * r - mid)).sum())
        info = np.zeros((k + 1, k + 1))
        info[:k, :k] = (x * (w * h)[:, None]).T @ x / s**2
        info[:k, k] = info[k, :k] = x.T @ (w * (h * r + g)) / s
        info[k, k] = (w * (h * r * r + g * r)).sum()
        return (w * ln).sum(), grad, info

    theta, value, info = newton(lambda t: _batch_step(d, t, kernel), np.append(base.gamma, math.log(base.stats["rmse"])))
    v = np.linalg.inv(info)
    return _finish(d, "tobit", y, theta, value, info, "classical", None, None, {"sigma": math.exp(theta[-1]), "ln_sigma_se": math.sqrt(max(v[-1, -1], 0))})
