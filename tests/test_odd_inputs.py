"""Missing numbers, names with dots, pages without ends, densities of nothing, panels with gaps."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.estimate import did
from tabulon.operators import charts, columns, rows, summary, text
from tabulon.sources import files, html


def test_nan_is_missing_on_load(spark, tmp_path):
    path = f"file://{tmp_path}/nan"
    spark.createDataFrame([(1.0, 1, "a"), (math.nan, 2, "b")], "`x.y` double, k int, s string").write.parquet(path)
    assert [tuple(r) for r in files.use(spark, path).orderBy("k").collect()] == [(1.0, 1, "a"), (None, 2, "b")]
    assert math.isnan(files.use(spark, path, nan_missing=False).orderBy("k").collect()[1][0])
    plan = files.use(spark, path).filter("k > 1")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,1)" in plan


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (3, 4.0)], "`a.b` int, `c.d` double")
    assert {r["variable"] for r in summary.summarize(df, detail=True).collect()} == {"a.b", "c.d"}
    assert sorted(r["n"] for r in rows.duplicates_tag(df, ["a.b"], "n").collect()) == [0, 1, 1]
    assert rows.duplicates_drop(df, ["a.b"], ["-c.d"]).count() == 2
    assert rows.duplicates_report(df, "a.b").count() == 2
    assert [r["n"] for r in rows.number_rows(df, ["-c.d"], "n", ["a.b"], "all").orderBy("n").collect()] == [1, 1, 2]
    assert summary.collapse(df, {"m.1": ("median", "c.d")}, ["a.b"]).columns == ["a.b", "m.1"]
    assert summary.tabstat(df, ["c.d"], ["p50"], ["a.b"]).columns == ["a.b", "stat", "c.d"]


def test_tables_in_any_case_and_without_an_end(spark):
    pages = [(1, "<Table><TR><td>a<td>b</Table>"), (2, "<p>x<table><tr><td>c</td></tr><tr><td>d"), (3, "<TABLE><tr><td>out<table><tr><td>in"), (4, "no table"), (5, None)]
    got = html.html_tables(spark.createDataFrame(pages, "page_id int, html string")).collect()
    found = {}
    for r in sorted(got):
        found.setdefault((r["page_id"], r["table_idx"]), []).append(r["cells"])
    assert found[1, 0] == [["a", "b"]] and found[2, 0] == [["c"], ["d"]] and {p for p, _ in found} == {1, 2, 3}
    assert [["in"]] in [found[k] for k in found if k[0] == 3]


def test_densities(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, 700), r.normal(8, 0.5, 300)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "`v.1` double")
    sd, n = x.std(ddof=1), len(x)
    h = n**-0.2 * sd
    at = np.linspace(x.min() - sd, x.max() + sd, 300)
    want = np.exp(-(((at[:, None] - x[None, :]) / h) ** 2) / 2).sum(1) / (n * h * math.sqrt(2 * math.pi))
    peak = 1 / (h * math.sqrt(2 * math.pi))
    for exact, tolerance in ((True, 1e-12), (False, peak / 32_768)):
        got = sorted((r["x"], r["density"]) for r in charts.kdensity(df, "v.1", exact=exact).collect())
        assert np.allclose([g[0] for g in got], at) and np.abs(np.array([g[1] for g in got]) - want).max() <= tolerance
    # the kernel's work does not follow the number of values
    assert charts.kdensity(df.limit(0), "v.1").count() == 0
    assert charts.kdensity(df.limit(1), "v.1").count() == 0
    assert charts.kdensity(df.select(F.lit(3.0).alias("v.1")), "v.1").count() == 0


def panel(spark, times, effect=2.0, holes=()):
    data = []
    for u in range(60):
        g = (0, times[2], times[3])[u % 3]
        for k, t in enumerate(times):
            if (u, t) not in holes:
                data.append((u, t, g, u * 0.5 + k * 1.0 + (effect if g and t >= g else 0.0)))
    return spark.createDataFrame(data, "u int, t int, g int, y double")


def test_staggered_effects_of_a_panel_with_gaps(spark):
    biennial = panel(spark, [1996, 1998, 2000, 2004, 2006])
    cells = did.att_gt(biennial, "y", "u", "t", "g").collect()
    assert {(r["g"], r["t"]) for r in cells} == {(g, t) for g in (2000, 2004) for t in (1996, 1998, 2000, 2004, 2006)}
    assert all(r["att"] == pytest.approx(2.0 if r["t"] >= r["g"] else 0.0, abs=1e-9) for r in cells)
    assert did.callaway_santanna(biennial, "y", "u", "t", "g").first()["att"] == pytest.approx(2.0)
    # one unit lacks its base period, a cohort its last one
    holes = {(4, 1998)} | {(u, 2000) for u in range(60) if u % 3 == 2}
    some = did.att_gt(panel(spark, [1996, 1998, 2000, 2004, 2006], holes=holes), "y", "u", "t", "g").collect()
    assert all(r["att"] == pytest.approx(2.0 if r["t"] >= r["g"] else 0.0, abs=1e-9) for r in some)
    assert {r["n"] for r in some if r["g"] == 2000} == {19} and {r["n"] for r in some if r["g"] == 2004} == {20}


def test_cohorts_treated_from_the_start(spark):
    always = panel(spark, [1996, 1998, 2000, 2004]).withColumn("g", F.when(F.col("g") == 2000, 1996).otherwise(F.col("g")))
    with pytest.raises(ValueError, match="1996"):
        did.att_gt(always, "y", "u", "t", "g")
    assert {r["g"] for r in did.att_gt(always, "y", "u", "t", "g", always="drop").collect()} == {2004}


def test_two_by_two_with_an_empty_cell(spark):
    df = spark.createDataFrame([(1.0, 0, 0), (2.0, 0, 1), (3.0, 1, 1)], "y double, d int, p int")
    with pytest.raises(ValueError, match="d = 1, post = 0"):
        did.did2x2(df, "y", "d", F.col("p"))


def test_too_many_columns(spark, monkeypatch):
    df = spark.range(40).select((F.col("id") % 2).alias("i"), F.col("id").alias("j"), F.lit(1).alias("v"))
    assert len(columns.to_wide(df, ["v"], ["i"], "j").columns) == 41
    monkeypatch.setattr(columns, "MAX_WIDE", 39)
    with pytest.raises(ValueError, match="39 columns"):
        columns.to_wide(df, ["v"], ["i"], "j")


def test_embeddings_are_principal_directions(spark):
    r = np.random.default_rng(7)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    texts = [" ".join(r.choice(topics[k % 4], 30)) + f" own{k}" for k in range(80)] + [None, "", "t0wone more"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = text.embed(df, "i", "t", dims=3, features=64)
    assert got.columns == ["i", "emb_1", "emb_2", "emb_3"]
    y = np.array([x[1:] for x in sorted(got.collect())])
    again = np.array([x[1:] for x in sorted(text.embed(df.repartition(5), "i", "t", dims=3, features=64).collect())])
    assert np.allclose(y, again, atol=1e-9)
    # a dense decomposition of the same features
    hashed = df.select("i", F.transform(F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(text.WORD), 0), lambda w: F.pmod(F.xxhash64(w), F.lit(64))).alias("f"))
    x = np.zeros((len(texts), 64))
    for row in hashed.collect():
        for f in row["f"]:
            x[row["i"], f] += 1
    x *= np.array([math.log((len(texts) + 1) / ((x[:, f] > 0).sum() + 1)) if (x[:, f] > 0).any() else 0.0 for f in range(64)])
    c = (x - x.mean(0)).T @ (x - x.mean(0))
    v = np.linalg.eigh(c)[1][:, ::-1][:, :3]
    v *= np.sign(v[np.abs(v).argmax(0), np.arange(3)])
    assert np.allclose(np.abs(y), np.abs(x @ v), atol=0.02 * np.abs(y).max())
    assert np.allclose(y[80], 0) and np.allclose(y[81], 0)
