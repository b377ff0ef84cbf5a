"""Regressions with a factor of many levels, against a dummy a level."""

from __future__ import annotations

import numpy as np
import pytest

from tabulon.estimate import design, linear


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(400):
        f, k = int(r.integers(0, 40)), "abc"[int(r.integers(0, 3))]
        x = float(r.normal()) + f
        rows.append((f, k, x, float(r.normal()), float(f * f + 2 * x + r.normal()), int(r.integers(1, 4)), int(r.integers(0, 25))))
    rows += [(None, "a", 1.0, 1.0, 1.0, 1, 1), (3, "a", None, 1.0, 1.0, 1, 1), (3, None, 1.0, 1.0, 1.0, 1, 1)]
    return spark.createDataFrame(rows, "f int, k string, x double, z double, y double, w int, cl int").cache()


@pytest.mark.parametrize("vcov", ["classical", "hc1", ("cluster", "cl"), ("cluster", "f")])
@pytest.mark.parametrize("weight,wtype", [(None, "aweight"), ("w", "aweight"), ("w", "fweight")])
def test_swept_out_levels_equal_dummies(frame, monkeypatch, vcov, weight, wtype):
    want = linear.ols(frame, "y", ["x", "z"], ["k", "f"], weight=weight, wtype=wtype, vcov=vcov)
    monkeypatch.setattr(design, "MAX_LEVELS", 10)
    got = linear.ols(frame, "y", ["x", "z"], ["k", "f"], weight=weight, wtype=wtype, vcov=vcov)
    assert got.names == ["x", "z", "b.k", "c.k"] and got.n == want.n and got.df == want.df
    for c in got.names:
        assert np.isclose(got[c], want[c]) and np.isclose(got.se(c), want.se(c))
    for s in ("r2", "adj_r2", "rmse", "rss", "df_resid"):
        assert np.isclose(got.stats[s], want.stats[s]), s
    levels = {r["level"]: r["effect"] for r in linear.level_effects(frame, got, "f", weight).collect()}
    first = min(levels)
    assert np.isclose(levels[first], want["_cons"])
    assert all(np.isclose(e - levels[first], want[f"{v}.f"]) for v, e in levels.items() if v != first)


def test_five_thousand_levels_and_what_cannot_be_swept(spark, monkeypatch):
    df = spark.range(15000).selectExpr("id % 5000 AS f", "cast(id % 7 AS double) AS x", "cast((id % 7) * 3 + (id % 5000) AS double) AS y")
    fit = linear.ols(df, "y", ["x"], ["f"])
    assert np.isclose(fit["x"], 3) and fit.stats["n_levels"] == 5000 and fit.stats["df_resid"] == 9999
    with pytest.raises(design.ManyLevels):
        linear.ols(df, "y", ["x"], ["f"], constant=False)
    with pytest.raises(design.ManyLevels):
        linear.ols(df.selectExpr("*", "f AS g"), "y", ["x"], ["f", "g"])
