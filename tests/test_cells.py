"""Cohort x period regressions by blocks, against dense dummies."""

from __future__ import annotations

import numpy as np
import pytest

from tabulon.estimate import did, panel
from tabulon.estimate.cells import cell_regression


def _rows(seed: int, never: bool = True):
    """An unbalanced panel with gaps, repeated rows and a covariate of large scale."""
    r = np.random.default_rng(seed)
    out = []
    for u in range(40):
        g = (0, 3, 4, 6)[u % 4] if never else (3, 4, 6)[u % 3]
        for t in range(1, 8):
            if r.random() < 0.85:
                for _ in range(2 if r.random() < 0.05 else 1):
                    x = float(r.normal()) * 1000 + t
                    out.append((u, t, g, float(u % 7 + 0.3 * t + (t - g if g and t >= g else 0) + 0.002 * x + r.normal()), x))
    return out


def _dense(rows, vcov, k=1):
    """(e: estimate, error, rows) by pseudo-inverse of all dummies."""
    u, t, g, y, x = (np.array(c) for c in zip(*rows, strict=True))
    cells = sorted({(int(a), int(b - a)) for a, b in zip(g, t, strict=True) if a and b - a != -1})
    z = np.column_stack([*((u == a).astype(float) for a in sorted(set(u))), *((t == a).astype(float) for a in sorted(set(t))[1:])])
    d = np.column_stack([*(((g == a) & (t - g == b)).astype(float) for a, b in cells), *([x / 1000] if k else [])])
    m = d - z @ np.linalg.pinv(z) @ d
    yy = y - z @ np.linalg.pinv(z) @ y
    bread = np.linalg.pinv(m.T @ m)
    b = bread @ m.T @ yy
    e = yy - m @ b
    df = len(y) - z.shape[1] - np.linalg.matrix_rank(m)
    if vcov == "classical":
        v = bread * (e @ e) / df
    else:
        s = np.array([(m * e[:, None])[u == a].sum(axis=0) for a in sorted(set(u))])
        v = bread @ s.T @ s @ bread * len(s) / (len(s) - 1) * (len(y) - 1) / df
    out = {}
    for key in sorted({c[1] for c in cells}):
        w = np.array([((g == a) & (t - g == c)).sum() if c == key else 0 for a, c in cells] + [0] * k, float)
        n = int(w.sum())
        w /= n
        out[key] = (w @ b, np.sqrt(w @ v @ w), n)
    return out


@pytest.mark.parametrize("vcov", ["cluster", "classical"])
@pytest.mark.parametrize("covariates", [[], ["x"]])
def test_blocks_equal_dense_dummies(spark, vcov, covariates):
    rows = _rows(7)
    df = spark.createDataFrame(rows, "u int, t int, g int, y double, x double")
    want = _dense(rows, vcov, len(covariates))
    got = {r["e"]: (r["att"], r["se"], r["n"]) for r in did.sun_abraham(df, "y", "u", "t", "g", covariates, vcov).collect()}
    assert got.keys() == want.keys()
    for e in want:
        assert np.allclose(got[e], want[e], rtol=1e-6), e


def test_odd_panels(spark):
    kind = "u int, t int, g int, y double"
    df = spark.createDataFrame([r[:4] for r in _rows(1)] + [(99, 1, 0, None), (98, None, 3, 1.0)], kind)
    assert did.sun_abraham(df, "y", "u", "t", "g").count() == did.sun_abraham(df.dropna(), "y", "u", "t", "g").count()
    assert did.sun_abraham(df.filter("g = 0 OR g IS NULL"), "y", "u", "t", "g").count() == 0
    assert did.sun_abraham(df.limit(0), "y", "u", "t", "g").count() == 0
    with pytest.raises(ValueError, match="varies"):
        did.sun_abraham(df.unionByName(spark.createDataFrame([(0, 1, 5, 1.0)], kind)), "y", "u", "t", "g")
    with pytest.raises(ValueError, match="kind"):
        did.sun_abraham(df, "y", "u", "t", "g", vcov="hc1")


def test_five_thousand_cells(spark):
    """70 cohorts in 74 periods: effects without noise come back as they were put in."""
    r = np.random.default_rng(0)
    rows, effect = [], {}
    for u in range(75):
        g = u - 4 + 3 if u >= 5 else 0
        for t in range(1, 75):
            if g and t - g != -1:
                effect[g, t] = float(r.normal())
            rows.append((u, t, g, float(u % 9 + 0.1 * t) + effect.get((g, t), 0.0)))
    df = spark.createDataFrame(rows, "u int, t int, g int, y double")
    fit = cell_regression(df, 0, lambda cells: np.eye(3, len(cells)), True, did.MAX_CELLS)
    assert len(fit.cells) == len(effect) > 5000
    assert max(abs(fit.cells[c][0] - v) for c, v in effect.items()) < 1e-7
    assert fit.rss < 1e-8 and fit.df_resid == 5 * 74 - 5 - 73


def test_two_way_dummies_agree_on_one_cell(spark):
    """A single cohort and base: the dense two-way fit of the same dummies."""
    rows = [r for r in _rows(3) if r[2] in (0, 4)]
    df = spark.createDataFrame(rows, "u int, t int, g int, y double, x double")
    names = {f"c{t}": t for t in range(1, 8) if t != 3}
    wide = df.selectExpr("*", *(f"CAST(g = 4 AND t = {t} AS DOUBLE) AS {c}" for c, t in names.items()))
    fit = panel.twoway(wide, "y", list(names), "u", "t", "cluster")
    got = {r["e"]: r for r in did.sun_abraham(df, "y", "u", "t", "g").collect()}
    for c, t in names.items():
        assert np.isclose(got[t - 4]["att"], fit[c]) and np.isclose(got[t - 4]["se"], fit.se(c))
