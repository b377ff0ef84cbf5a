"""Quantiles, variances, numbers, lags and samples in groups of any size."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import charts, quantiles, rows, summary, windows

PS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 1.0]


def midpoint(x, w, p):
    order = np.lexsort((w, x))
    x, w = np.asarray(x)[order], np.asarray(w, float)[order]
    return float(np.interp(p, (np.cumsum(w) - w / 2) / w.sum(), x))


@pytest.fixture(scope="module")
def table(spark):
    """A group with most rows, ties, nulls, NaN and weights that do not count."""
    r = random.Random(3)
    data = [("hot" if r.random() < 0.8 else r.choice(["a", None]), r.choice([None, math.nan, float(r.randint(0, 30)), r.gauss(0, 1e6)]), r.choice([None, 0, 1, 2, 7]), r.gauss(5, 2)) for _ in range(1500)]
    return spark.createDataFrame(data, "g string, x double, w int, `y.z` double"), data


@pytest.mark.parametrize("limits", [{}, {"GROUP_ROWS": 10}, {"GROUP_ROWS": 10, "NEAR_VALUES": 40, "SKETCH": 60}, {"GROUP_ROWS": 10, "MAX_GROUPS": 1}])
@pytest.mark.parametrize("grid", [False, True])
def test_every_plan_of_quantiles(table, limits, grid, monkeypatch):
    df, data = table
    for name, value in limits.items():
        monkeypatch.setattr(quantiles, name, value)
    for by in ([], ["g"]):
        got = {(*(r[b] for b in by), r["variable"], r["p"]): r["q"] for r in quantiles.quantiles(df, ["x", "y.z"], PS, by, midpoint=grid).collect()}
        want = {}
        for g in {row[0] for row in data} if by else [None]:
            for k, name in ((1, "x"), (3, "y.z")):
                own = [row[k] for row in data if (not by or row[0] == g) and row[k] is not None and not math.isnan(row[k])]
                for p in PS:
                    want[(*([g] if by else []), name, p)] = midpoint(own, [1] * len(own), p) if grid else float(np.quantile(own, p))
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


@pytest.mark.parametrize("limit", [100_000, 10])
def test_weighted_quantiles_in_groups(table, limit, monkeypatch):
    df, data = table
    monkeypatch.setattr(quantiles, "GROUP_ROWS", limit)
    got = {(r["g"], r["p"]): r["q"] for r in quantiles.quantile_mid(df, "x", PS, ["g"], F.col("w")).collect()}
    for g in {row[0] for row in data}:
        own = [(x, w) for h, x, w, _ in data if h == g and x is not None and not math.isnan(x) and w]
        for p in PS:
            assert got[g, p] == pytest.approx(midpoint(*zip(*own, strict=True), p), rel=1e-9, abs=1e-9)


def test_weights_reach_every_statistic(spark):
    df = spark.createDataFrame([("k", 1.0, 1), ("k", 2.0, 1), ("k", 3.0, 100), ("k", 9.0, 0), ("k", math.nan, 5)], "g string, v double, w int")
    want = midpoint([1, 2, 3], [1, 1, 100], 0.5)
    assert want == pytest.approx(2.98, abs=0.01)
    w = F.col("w")
    assert summary.collapse(df, {"m": ("median", "v")}, ["g"], weight=w).first()["m"] == pytest.approx(want)
    assert summary.tabstat(df, ["v"], ["median"], ["g"], weight=w).first()["v"] == pytest.approx(want)
    assert summary.tabstat(df, ["v"], ["iqr"], weight=w).first()["v"] == pytest.approx(midpoint([1, 2, 3], [1, 1, 100], 0.75) - midpoint([1, 2, 3], [1, 1, 100], 0.25))
    detail = summary.summarize(df, "v", weight=w, detail=True).first()
    assert detail["p50"] == pytest.approx(want) and detail["max"] == 3
    assert charts.bar(df, "v", ["g"], "median", weight=w).first()["median"] == pytest.approx(want)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (math.nan, 2), (3.0, None)], "v double, k int")
    r = {x["variable"]: x for x in summary.summarize(df, detail=True).collect()}
    assert (r["v"]["n"], r["v"]["mean"], r["v"]["max"], r["v"]["p50"]) == (2, 2.0, 3.0, 2.0) and r["k"]["n"] == 2
    assert summary.collapse(df, {"top": ("max", "v"), "first": ("sum", "k")}).first().asDict() == {"top": 3.0, "first": 3}


@pytest.mark.parametrize("wtype", ["fweight", "aweight", "iweight"])
def test_variances_of_large_values(spark, wtype):
    r = np.random.default_rng(1)
    for g, size in (("far", 1e9), ("near", 0.0)):
        x, w = r.normal(0, 1, 400) + size, r.integers(1, 9, 400)
        part = spark.createDataFrame([(g, float(a), int(b)) for a, b in zip(x, w, strict=True)], "g string, x double, w int")
        other = part.select(F.lit("other").alias("g"), (F.col("x") - size).alias("x"), "w")
        m = (x * w).sum() / w.sum()
        ss = (w * (x - m) ** 2).sum()
        want = {"fweight": ss / (w.sum() - 1), "iweight": ss / w.sum(), "aweight": ss * 400 / w.sum() / 399}[wtype]
        got = summary.collapse(part.union(other), {"sd": ("sd", "x"), "var": ("var", "x")}, ["g"], weight=F.col("w"), wtype=wtype)
        one = got.filter(F.col("g") == g).first()
        assert one["var"] == pytest.approx(want, rel=1e-9) and one["sd"] == pytest.approx(want**0.5, rel=1e-9)


def test_numbers_and_lags_cross_partitions(spark):
    r = random.Random(5)
    data = [("hot" if k % 3 else r.choice(["a", None, "b.c"]), k, r.randint(0, 9)) for k in range(900)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "`g.x` string, t int, v int")
    at = windows.number(df.withColumnRenamed("g.x", "g"), ["t"], ["g"])
    groups = {}
    for g, t, v in sorted(data, key=lambda x: x[1]):
        groups.setdefault(g, []).append((t, v))
    got = {(x["g"], x["t"]): (x["_n"], x["_n_all"]) for x in at.collect()}
    assert got == {(g, t): (i + 1, len(ts)) for g, ts in groups.items() for i, (t, _) in enumerate(ts)}
    parts = rows.dealt(df.withColumnRenamed("g.x", "g"), ["g", "t"]).filter("g = 'hot'").select("_part").distinct().count()
    assert parts > 1  # a group with two thirds of all rows is several tasks
    for lag in (1, 4):
        lagged = rows.lagged(df.withColumnRenamed("g.x", "g"), {"before": "v"}, ["g"], ["t"], lag)
        want = {(g, t): ts[i - lag][1] if i >= lag else None for g, ts in groups.items() for i, (t, _) in enumerate(ts)}
        assert {(x["g"], x["t"]): x["before"] for x in lagged.collect()} == want
    total = rows.running_total(df.withColumnRenamed("g.x", "g"), ["t"], F.col("v").cast("double"), "run", ["g"], "all")
    for x in total.collect():
        own = groups[x["g"]]
        assert x["run"] == sum(v for t, v in own if t <= x["t"]) and x["all"] == sum(v for _, v in own)


def test_samples_draw_each_row_for_itself(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 9 < 6, "O").when(F.col("id") % 9 < 8, "F").otherwise("P").alias("s"))
    counts = Counter(r["s"] for r in rows.sample_rows(df, 900, 4).collect())
    chi2 = sum((counts[s] - 900 * p) ** 2 / (900 * p) for s, p in (("O", 6 / 9), ("F", 2 / 9), ("P", 1 / 9)))
    assert counts.total() == 900 and chi2 < 13.8  # one in a thousand
    again = Counter(r["s"] for r in rows.sample_rows(df.repartition(7), 900, 4).collect())
    assert again == counts
    many = [Counter(r["s"] for r in rows.sample_rows(df, 90, seed).collect())["P"] for seed in range(6)]
    assert len(set(many)) > 1 and all(n < 40 for n in many)


def test_samples_of_single_and_repeated_rows(spark, monkeypatch):
    df = spark.range(300).select(F.when(F.col("id") < 100, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit(None).cast("string").alias("n"))
    for limit in (100_000, 0):
        monkeypatch.setattr(rows, "MAX_REPEATED", limit)
        got = Counter(r["k"] for r in rows.sample_rows(df, 150, 2).collect())
        assert got.total() == 150 and 20 < got[-1] < 80 and all(n == 1 for k, n in got.items() if k != -1)
    monkeypatch.setattr(rows, "COPIES", 7)
    assert Counter(r["k"] for r in rows.sample_rows(df, 150, 2).collect()) == got
    assert rows.sample_rows(df, 300).count() == 300 and rows.sample_rows(df, 1).count() == 1 and rows.sample_rows(df, 299).count() == 299


@pytest.mark.parametrize("grid", [False, True])
def test_few_values_are_counted_first(spark, grid):
    data = [("a" if k % 3 else "b", float(k * k % 11)) for k in range(600)] + [("c", None), ("a", math.nan)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {(r["g"], r["p"]): r["q"] for r in quantiles.quantiles(df, ["x"], PS, ["g"], midpoint=grid).collect()}
    for g in "ab":
        own = [x for h, x in data if h == g and not math.isnan(x)]
        for p in PS:
            assert got[g, p] == pytest.approx(midpoint(own, [1] * len(own), p) if grid else float(np.quantile(own, p)))
    assert len(got) == 2 * len(PS)
