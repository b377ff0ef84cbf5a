"""Estimators against NumPy and by identities."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.estimate import did, linear, mle, panel, post


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(7)
    n = 400
    x, z, g = r.normal(size=n) * 3 + 1000, r.normal(size=n), r.integers(0, 20, n)
    u = r.normal(size=n)
    y = 2 + 0.5 * x - z + u + r.normal(size=20)[g]
    xb = 0.4 * z - 0.3
    return {
        "x": x, "z": z, "g": g, "y": y, "w": r.integers(1, 4, n), "b": (r.random(n) < 1 / (1 + np.exp(-xb))).astype(int),
        "c": r.poisson(np.exp(0.3 + 0.5 * z)), "nb": r.poisson(np.exp(0.3 + 0.5 * z) * r.gamma(2, 0.5, n)), "t": np.arange(n), "iv": x + r.normal(size=n),
    }


@pytest.fixture(scope="module")
def frame(spark, data):
    names = list(data)
    rows = [tuple(float(data[k][i]) if k in ("x", "z", "y", "iv") else int(data[k][i]) for k in names) for i in range(400)]
    return spark.createDataFrame(rows, ", ".join(f"{k} {'double' if k in ('x', 'z', 'y', 'iv') else 'int'}" for k in names)).cache()


def X(data):
    return np.column_stack([data["x"], data["z"], np.ones(400)])


def test_ols_and_covariances(frame, data):
    x, y = X(data), data["y"]
    xi = np.linalg.inv(x.T @ x)
    b = xi @ x.T @ y
    e = y - x @ b
    fit = linear.ols(frame, "y", ["x", "z"])
    assert np.allclose(fit.b, b, rtol=1e-8) and np.allclose(fit.v, xi * (e @ e) / 397, rtol=1e-7)
    hc1 = linear.ols(frame, "y", ["x", "z"], vcov="hc1")
    assert np.allclose(hc1.v, xi @ (x * (e**2)[:, None]).T @ x @ xi * 400 / 397, rtol=1e-7)
    s = np.array([(x * e[:, None])[data["g"] == k].sum(axis=0) for k in range(20)])
    cl = linear.ols(frame, "y", ["x", "z"], vcov=("cluster", "g"))
    assert np.allclose(cl.v, xi @ s.T @ s @ xi * 20 / 19 * 399 / 397, rtol=1e-7)
    w = fit.wald("x", "z")
    assert w["df"] == 2 and w["p"] < 1e-6


def test_weights(frame, spark, data):
    rep = spark.createDataFrame([(float(data["x"][i]), float(data["z"][i]), float(data["y"][i])) for i in range(400) for _ in range(data["w"][i])], "x double, z double, y double")
    f, r = linear.ols(frame, "y", ["x", "z"], weight="w", wtype="fweight"), linear.ols(rep, "y", ["x", "z"])
    assert np.allclose(f.b, r.b) and np.allclose(f.v, r.v, rtol=1e-6)
    a1 = linear.ols(frame, "y", ["z"], weight="w")
    a2 = linear.ols(frame.withColumn("w", F.col("w") * 5), "y", ["z"], weight="w")
    assert np.allclose(a1.v, a2.v)


def test_factors_are_dummies(frame):
    fit = linear.ols(frame, "y", ["x", "z"], factors=["g"])
    assert len(fit.terms) == 22
    fe = panel.xtreg_fe(frame, "y", ["x", "z"], "g")
    assert np.allclose(fe.b, fit.b[:2], rtol=1e-6) and np.allclose(fe.v, fit.v[:2, :2], rtol=1e-5)


def newton_np(x, y, f):
    t = np.zeros(x.shape[1])
    for _ in range(60):
        g, h = f(x, y, t)
        t = t + np.linalg.solve(h, g)
    return t, np.linalg.inv(h)


def test_logit_poisson_probit(frame, data):
    z = np.column_stack([data["z"], np.ones(400)])

    def lg(x, y, t):
        p = 1 / (1 + np.exp(-x @ t))
        return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x

    b, v = newton_np(z, data["b"], lg)
    fit = mle.logit(frame, "b", ["z"])
    assert np.allclose(fit.b, b, rtol=1e-6) and np.allclose(fit.v, v, rtol=1e-5) and fit.stats["chi2"] > 0

    def po(x, y, t):
        m = np.exp(x @ t)
        return x.T @ (y - m), (x * m[:, None]).T @ x

    b, v = newton_np(z, data["c"], po)
    fit = mle.poisson(frame, "c", ["z"])
    assert np.allclose(fit.b, b, rtol=1e-6) and np.allclose(fit.v, v, rtol=1e-5)
    pr = mle.probit(frame, "b", ["z"])
    assert abs(pr["z"] * 1.6 - mle.logit(frame, "b", ["z"])["z"]) < 0.1
    k = post.margins(frame, fit, dydx=["z"]).first()["margin"]
    assert math.isclose(k, fit["z"] * float(np.mean(data["c"])), rel_tol=1e-5)


def test_nbreg_and_tobit_reach_their_optimum(frame, data):
    nb = mle.nbreg(frame, "nb", ["z"])
    assert 0.2 < nb.stats["alpha"] < 1.2 and abs(nb["z"] - 0.5) < 0.2
    cut = frame.withColumn("yc", F.greatest(F.col("z"), F.lit(-0.5)))
    tb = mle.tobit(cut.withColumn("zz", F.col("z") * 0 + F.col("t") % 7), "yc", ["zz"], ll=-0.5)
    assert abs(tb.stats["sigma"] - 1) < 0.15 and abs(tb["_cons"] - float(np.mean(data["z"]))) < 0.3


def test_iv(frame, data):
    z = np.column_stack([data["iv"], data["z"], np.ones(400)])
    x = np.column_stack([data["x"], data["z"], np.ones(400)])
    b = np.linalg.solve(z.T @ x, z.T @ data["y"])
    fit = linear.iv2sls(frame, "y", ["z"], ["x"], ["iv"])
    assert np.allclose(fit.b, b, rtol=1e-6)
    assert (np.diag(linear.iv2sls(frame, "y", ["z"], ["x"], ["iv"], vcov="hc1").v) > 0).all()
    assert (np.diag(linear.iv2sls(frame, "y", ["z"], ["x"], ["iv"], vcov=("cluster", "g")).v) > 0).all()


def test_diagnostics(frame, data):
    fit = linear.ols(frame, "y", ["x", "z"])
    x = X(data)
    e = data["y"] - x @ np.linalg.lstsq(x, data["y"], rcond=None)[0]
    assert math.isclose(post.durbin_watson(frame, fit, ["t"]).first()[0], float((np.diff(e) ** 2).sum() / (e @ e)), rel_tol=1e-6)
    r = np.corrcoef(data["x"], data["z"])[0, 1]
    assert math.isclose(post.vif(frame, ["x", "z"]).first()["vif"], 1 / (1 - r * r), rel_tol=1e-6)
    for test in (post.hettest(frame, fit), post.white(frame, fit), post.breusch_godfrey(frame, fit, ["t"]), post.reset(frame, fit)):
        assert 0 <= test.first()["p"] <= 1


@pytest.fixture(scope="module")
def staggered(spark):
    r = np.random.default_rng(3)
    rows = []
    for u in range(24):
        g = (0, 3, 4, 5)[u % 4]
        a = float(r.normal())
        for t in range(1, 7):
            d = int(g > 0 and t >= g)
            rows.append((u, t, g, d, a + 0.3 * t + 0.5 * d + float(r.normal()) * 0.05))
    return spark.createDataFrame(rows, "u int, t int, g int, d int, y double").cache()


def test_did_identities(staggered):
    tw = did.twfe(staggered, "y", "d", "u", "t")
    ba = did.bacon(staggered, "y", "u", "t", "g").agg(F.sum(F.col("estimate") * F.col("weight")), F.sum("weight")).first()
    assert math.isclose(tw["d"], ba[0], rel_tol=1e-8) and math.isclose(ba[1], 1)
    bjs = did.imputation(staggered, "y", "d", "u", "t").first()["att"]
    ga = did.gardner(staggered, "y", "d", "u", "t")
    assert math.isclose(bjs, ga["d"], rel_tol=1e-7)
    cs = did.callaway_santanna(staggered, "y", "u", "t", "g").first()["att"]
    for b in (tw["d"], bjs, cs):
        assert abs(b - 0.5) < 0.1
    assert 0 < did.simple_att_se(staggered, "y", "u", "t", "g") < 0.1
    sa = {r["e"]: r["att"] for r in did.sun_abraham(staggered, "y", "u", "t", "g").collect()}
    assert all(abs(v - (0.5 if e >= 0 else 0)) < 0.15 for e, v in sa.items())
    assert abs(did.stacked(staggered, "y", "u", "t", "g", (-2, 1))["d"] - 0.5) < 0.15


def test_unbalanced_two_way_equals_dummies(staggered):
    part = staggered.filter("NOT (u % 5 = 0 AND t = 2)")
    a = did.twfe(part, "y", "d", "u", "t")
    b = linear.ols(part, "y", ["d"], factors=["u", "t"])
    assert math.isclose(a["d"], b["d"], rel_tol=1e-6)


def test_random_effects_and_description(staggered):
    re = panel.xtreg_re(staggered, "y", ["d", "t"], "u")
    assert abs(re["d"] - 0.5) < 0.1 and re.stats["sigma2_u"] > 0
    assert panel.xtset(staggered, "u", "t").first()["balanced"]


def dense(rows, xs, y, factor=None, constant=True):
    """(X, y) with dummies of the factor's later levels."""
    x = [np.array([r[c] for r in rows], float) for c in xs]
    if factor:
        x += [np.array([float(r[factor] == v) for r in rows]) for v in sorted({r[factor] for r in rows})[1:]]
    if constant:
        x.append(np.ones(len(rows)))
    return np.column_stack(x), np.array([r[y] for r in rows], float)


def residual(x, y):
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def r2(x, y):
    return 1 - (residual(x, y) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(11)
    n = 400
    rows = [(int(i), float(a), float(b), "pqrs"[i % 4]) for i, (a, b) in enumerate(zip(r.normal(size=n), r.normal(size=n), strict=True))]
    rows = [(*x, x[1] - 0.5 * x[2] + {"p": 0, "q": 1, "r": -1, "s": 2}[x[3]] + float(r.normal()) * (1 + 0.3 * abs(x[1]))) for x in rows]
    df = spark.createDataFrame(rows, "i long, a double, b double, f string, y double")
    return df, df.collect()


def test_diagnostics_with_a_factor_match_dense_algebra(sample):
    df, rows = sample
    fit = linear.ols(df, "y", ["a", "b"], factors=["f"])
    x, y = dense(rows, ["a", "b"], "y", "f")
    e = residual(x, y)
    n = len(y)
    close = lambda got, want: np.isclose(got, want, rtol=1e-6)
    bp = post.hettest(df, fit).first()
    assert bp["df"] == 5 and close(bp["chi2"], n * r2(x, e * e))
    own = x[:, :-1]
    pairs = np.column_stack([own, *(own[:, i] * own[:, j] for i in range(5) for j in range(i + 1)), np.ones(n)])
    wh = post.white(df, fit).first()
    assert wh["df"] == np.linalg.matrix_rank(pairs) - 1 and close(wh["chi2"], n * r2(pairs, e * e))
    lags = np.column_stack([np.append(np.zeros(k), e[:-k]) for k in (1, 2)])
    bg = post.breusch_godfrey(df, fit, ["i"], 2).first()
    assert close(bg["chi2"], n * r2(np.column_stack([x, lags]), e))
    yhat = y - e
    big = np.column_stack([x, yhat**2, yhat**3])
    rss = [(residual(m, y) ** 2).sum() for m in (x, big)]
    re = post.reset(df, fit).first()
    assert re["df2"] == n - 8 and close(re["f"], (rss[0] - rss[1]) / 2 / (rss[1] / (n - 8)))
    bare = linear.ols(df, "y", ["a", "b"], constant=False)
    x0 = x[:, :2]
    yhat = x0 @ np.linalg.lstsq(x0, y, rcond=None)[0]
    rss = [(residual(m, y) ** 2).sum() for m in (x0, np.column_stack([x0, yhat**2, yhat**3]))]
    assert close(post.reset(df, bare).first()["f"], (rss[0] - rss[1]) / 2 / (rss[1] / (n - 4)))


def test_margins_with_a_factor(sample):
    df, rows = sample
    own = df.withColumn("z", (F.col("y") > 0).cast("int"))
    fit = mle.logit(own, "z", ["a", "b"], factors=["f"])
    x, _ = dense(rows, ["a", "b"], "y", "f")
    p = lambda m: 1 / (1 + np.exp(-(m @ fit.b)))

    def effect(b, name):
        q = lambda m: 1 / (1 + np.exp(-(m @ b)))
        if name == "a":
            return (q(x) * (1 - q(x))).mean() * b[0]
        on, off = x.copy(), x.copy()
        on[:, 2:5] = off[:, 2:5] = 0
        on[:, 2] = 1
        return (q(on) - q(off)).mean()

    got = {r["name"]: r for r in post.margins(own, fit, dydx=["a", "f"]).collect()}
    assert set(got) == {"a", "q.f", "r.f", "s.f"}
    for name in ("a", "q.f"):
        grad = np.array([(effect(fit.b + d, name) - effect(fit.b - d, name)) / 2e-5 for d in np.eye(6) * 1e-5])
        assert np.isclose(got[name]["margin"], effect(fit.b, name)) and np.isclose(got[name]["se"], np.sqrt(grad @ fit.v @ grad), rtol=1e-5)
    at = post.margins(own, fit, atmeans=True).first()
    assert np.isclose(at["margin"], p(x.mean(axis=0))) and at["kind"] == "at means" and at["low"] < at["margin"] < at["high"]


def test_effects_over_time_match_dense_algebra(spark):
    r = np.random.default_rng(5)
    first = {u: [0, 4, 5][u % 3] for u in range(30)}
    rows = [(u, t, first[u], int(0 < first[u] <= t), float(r.normal() + 0.3 * u + 0.2 * t + 0.5 * (0 < first[u] <= t)), float(r.normal())) for u in range(30) for t in range(1, 7)]
    rows = [x for x in rows if x[:2] != (3, 2)]  # not balanced
    df = spark.createDataFrame(rows, "u int, t int, g int, d int, y double, x double")
    u, t, g, d, y = (np.array([x[k] for x in rows], float) for k in range(5))
    z = np.column_stack([*((u == i).astype(float) for i in range(30)), *((t == i).astype(float) for i in range(2, 7))])
    free = d == 0
    inverse = np.linalg.pinv(z[free].T @ z[free])
    y0 = z @ (inverse @ z[free].T @ y[free])
    w = np.where(d == 1, 1 / d.sum(), 0.0)
    v = w.copy()
    v[free] = -(z[free] @ (inverse @ (z.T @ w)))
    e = y - y0
    for c in {(a, b) for a, b in zip(g[d == 1], t[d == 1], strict=True)}:
        same = (d == 1) & (g == c[0]) & (t == c[1])
        e[same] -= (y - y0)[same].mean()
    want = np.sqrt(sum((v * e)[u == i].sum() ** 2 for i in range(30)))
    got = did.imputation(df, "y", "d", "u", "t").first()
    assert np.isclose(got["att"], (y - y0)[d == 1].mean()) and np.isclose(got["se"], want, rtol=1e-6) and got["low"] < got["att"] < got["high"]
    events = {k["key"]: k for k in did.imputation(df, "y", "d", "u", "t", aggregate="event_study").collect()}
    assert sorted(events) == [0, 1, 2] and np.isclose(events[0]["att"], (y - y0)[(d == 1) & (t == g)].mean())
    ga = did.gardner(df, "y", "d", "u", "t", aggregate="event_study")
    assert ga.names == ["e+0", "e+1", "e+2"] and np.isclose(ga["e+0"], events[0]["att"])
    # two-way regression on cohort x period dummies, clustered by unit
    cells = sorted({(a, int(b - a)) for a, b in zip(g, t, strict=True) if a and b - a != -1})
    x = np.column_stack([*(((g == a) & (t - g == b)).astype(float) for a, b in cells), z])
    xx = np.linalg.pinv(x.T @ x)
    b = xx @ x.T @ y
    sa = {k["e"]: k for k in did.sun_abraham(df, "y", "u", "t", "g").collect()}
    n0 = {c: int(((g == c[0]) & (t - g == c[1])).sum()) for c in cells}
    mix = np.array([n0[c] if c[1] == 0 else 0 for c in cells], float)
    assert np.isclose(sa[0]["att"], (mix / mix.sum()) @ b[: len(cells)], rtol=1e-6) and sa[0]["se"] > 0
    # Callaway and Sant'Anna with a covariate: one cell by hand
    by = {(a, c): (yy, xx_) for a, c, yy, xx_ in zip(u, t, y, [k[5] for k in rows], strict=True)}
    diff = lambda i: by[i, 4][0] - by[i, 3][0]
    never, treated = [i for i in range(30) if first[i] == 0], [i for i in range(30) if first[i] == 4]
    m = np.array([[1, by[i, 3][1]] for i in never])
    beta = np.linalg.lstsq(m, np.array([diff(i) for i in never]), rcond=None)[0]
    att = np.mean([diff(i) - beta @ [1, by[i, 3][1]] for i in treated])
    cell = did.att_gt(df, "y", "u", "t", "g", covariates=["x"]).filter("g = 4 AND t = 4").first()
    assert np.isclose(cell["att"], att) and cell["se"] > 0 and cell["n"] == len(treated)
    st = did.stacked(df, "y", "u", "t", "g", (-2, 1), aggregate="event_study", vcov="cluster")
    assert st.names == ["e-2", "e+0", "e+1"] and 0 < st.se("e+0") < 2


def test_newton_ends_on_a_ridge_and_raises_without_a_maximum():
    # the first parameter has its maximum at 2, the second does not matter once it is large
    def ridge(t):
        left = np.exp(-np.exp(min(t[1], 6.0)))
        return -((t[0] - 2) ** 2) - left, np.array([-2 * (t[0] - 2), 1.0]), np.diag([2.0, 1.0])

    theta, ll, _ = mle.newton(ridge, np.zeros(2))
    assert abs(theta[0] - 2) < 1e-9 and ll > -1e-9
    with pytest.raises(ArithmeticError):
        mle.newton(lambda t: (float(t[0]), np.ones(1), np.eye(1)), np.zeros(1))
