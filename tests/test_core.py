"""Semantics that the driver tables cannot show: nulls, ties, chains, weights."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import distributions as D
from tabulon.functions import scalar as S
from tabulon.operators import columns as C
from tabulon.operators import fuzzy, joins, quantiles, rows, summary, text, windows
from tabulon.sources import files, html


@pytest.fixture(scope="module")
def nulls(spark):
    data = [("a", 1.0, 2), ("a", None, 1), ("b", 3.0, 0), (None, 4.0, 1), ("b", 5.0, None), ("a", 7.0, 1)]
    return spark.createDataFrame(data, "g string, x double, w int")


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_unknown_conditions(nulls):
    assert C.drop_if(nulls, F.col("x") > 3).count() == 3
    assert C.keep_if(nulls, F.col("x") > 3).count() == 3
    assert nulls.filter(S.ne_missing(F.col("x"), F.lit(1.0))).count() == 5


def test_null_groups(nulls):
    assert values(summary.collapse(nulls, {"s": ("sum", "x")}, ["g"]), "g", "s") == [("a", 8.0), ("b", 8.0)]
    assert summary.contract(nulls, "g").count() == 3 and summary.contract(nulls, "g", nomiss=True).count() == 2
    empty = summary.collapse(nulls.filter("x IS NULL"), {"s": ("sum", "x")}, ["g"])
    assert empty.first()["s"] == 0


def test_division_and_logs(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0)], "a double, b double")
    got = df.select(S.divide(F.col("a"), F.col("b")), S.ln(F.col("a")), S.mod(F.col("a"), F.lit(3.0)), S.trunc(F.col("a") * 1.5)).collect()
    assert [tuple(r) for r in got] == [(None, 0.0, 1.0, 1), (-0.5, None, 2.0, -1)]


def test_recode_runs_rule_by_rule(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    assert [r[0] for r in C.recode(df, "v", [(1, 2), (2, 3)]).collect()] == [3, 3, 3, None]
    assert [r[0] for r in C.recode(df, "v", [(1, 2), (2, 3)], simultaneous=True).collect()] == [2, 3, 3, None]
    assert [r[0] for r in C.recode(df, "v", [([1, 2], 9), ("else", 0)]).collect()] == [9, 9, 0, None]


def test_labels_follow(spark):
    df = C.with_label(spark.createDataFrame([(1,)], "v int"), "v", "a number")
    assert C.labels(C.clone(C.rename(df, "v", "w"), "w", "z"))["z"]["label"] == "a number"
    coded = C.with_value_labels(spark.createDataFrame([(1,), (5,)], "v int"), "v", {1: "one"})
    assert [r["t"] for r in C.decode(coded, "v", "t").collect()] == ["one", "5"]


def test_reshape(spark):
    wide = spark.createDataFrame([(1, 10, 11, 3, 4), (2, 20, 21, 5, 6)], "id int, inc80 int, inc81 int, ue_80 int, ue_81 int")
    long = C.to_long(wide, ["inc", "ue"], ["id"], "year")
    assert values(long, "id", "year", "inc", "ue") == [(1, 80, 10, 3), (1, 81, 11, 4), (2, 80, 20, 5), (2, 81, 21, 6)]
    back = C.to_wide(long, ["inc", "ue"], ["id"], "year")
    assert values(back, "id", "inc80", "inc81", "ue80", "ue81") == [(1, 10, 11, 3, 4), (2, 20, 21, 5, 6)]
    with pytest.raises(ValueError):
        C.to_wide(long.union(long.limit(1)), ["inc"], ["id"], "year")


def test_destring_tostring_compress(spark):
    df = spark.createDataFrame([("1,200", "x", 5), ("$ 3%", "2", None)], "a string, b string, c int")
    out = C.destring(df, "a", "b")
    assert values(out, "a", "b") == [(1200.0, "x"), (3.0, "2")]
    assert C.destring(df, "b", force=True).filter("b IS NULL").count() == 1
    assert sorted(r["c"] for r in C.tostring(df, "c").collect()) == ["", "5"]
    assert dict(C.compress(df.select("c")).dtypes)["c"] == "tinyint"


def test_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "X"), (3, "Z"), (None, "N")], "k int, v string")
    full = joins.merge(a, b, ["k"], "1:1")
    assert values(full, "k", "v", "v_using", "_merge") == sorted([(1, "x", "X", 3), (2, "y", None, 1), (3, None, "Z", 2), (None, "n", "N", 3)], key=str)
    assert joins.merge_how(a, b, ["k"], "outer").count() == 5
    assert joins.merge(a, b, ["k"], keep="match").count() == 2
    with pytest.raises(ValueError):
        joins.check_key(a.union(a), "k")
    grid = joins.fillin(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"), "x", "y")
    assert grid.count() == 4 and grid.filter("_fillin = 1").count() == 2


def midpoint(x, w, p):
    o = np.lexsort((w, x))
    x, w = np.asarray(x, float)[o], np.asarray(w, float)[o]
    return float(np.interp(p, (np.cumsum(w) - w / 2) / w.sum(), x))


def test_two_quantile_definitions(spark):
    r = np.random.default_rng(1)
    x, w = r.integers(0, 20, 200).astype(float), r.integers(1, 4, 200)
    df = spark.createDataFrame([(float(a), int(b), int(i % 2)) for i, (a, b) in enumerate(zip(x, w, strict=True))], "x double, w int, g int")
    ps = [0.01, 0.1, 0.25, 0.5, 0.9, 0.99]
    got = {q["p"]: q["q"] for q in quantiles.quantile_mid(df, "x", ps, weight=F.col("w")).collect()}
    for p in ps:
        assert math.isclose(got[p], midpoint(x, w, p), abs_tol=1e-9), p
    by = {(q["g"], q["p"]): q["q"] for q in quantiles.quantile_mid(df, "x", ps, ["g"]).collect()}
    for g in (0, 1):
        for p in ps:
            assert math.isclose(by[g, p], midpoint(x[g::2], np.ones(100), p), abs_tol=1e-9)
    q7 = {q["p"]: q["q"] for q in quantiles.quantile7(df, ["x"], ps).collect()}
    assert all(math.isclose(q7[p], np.quantile(x, p)) for p in ps)


def test_xtile_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double")
    classes = lambda alt: [r["c"] for r in quantiles.xtile(df, "c", "x", cutpoints=[2.0], altdef=alt).orderBy(F.asc_nulls_last("x")).collect()]
    assert classes(False) == [1, 2, 2, 2, None] and classes(True) == [1, 1, 1, 2, None]


def test_weighted_variance(spark):
    x, w = [1.0, 2.0, 4.0, 9.0], [1, 3, 2, 4]
    df = spark.createDataFrame(list(zip(x, w, strict=True)), "x double, w int")
    rep = np.repeat(x, w)
    got = df.agg(summary.wvar(F.col("x"), F.col("w"), "fweight"), summary.wvar(F.col("x"), F.col("w") * 7, "aweight"), summary.wvar(F.col("x"), F.col("w"), "aweight")).first()
    assert math.isclose(got[0], rep.var(ddof=1)) and math.isclose(got[1], got[2])
    assert df.agg(summary.wvar(F.col("x"), F.lit(0), "fweight")).first()[0] is None


def test_rows_and_numbers(spark):
    df = spark.range(1, 101).select("id", (F.col("id") % 7).alias("g"))
    numbered = rows.number_rows(df, ["-id"])
    assert numbered.filter("_n + id <> 101").count() == 0
    assert [r["id"] for r in rows.in_range(df, ["id"], 5, 7).orderBy("id").collect()] == [5, 6, 7]
    assert rows.sample_percent(df, 25).count() == 25
    assert rows.duplicates_drop(df, ["g"], ["-id"]).agg(F.min("id")).first()[0] == 94
    last = rows.sort(spark.createDataFrame([(None,), (1,), (2,)], "x int"), "-x").collect()
    assert [r["x"] for r in last] == [2, 1, None]
    got = windows.group_id(df, "k", "g").select("g", "k").distinct().orderBy("g").collect()
    assert [r["k"] for r in got] == [1, 2, 3, 4, 5, 6, 7]


def test_append(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([("q",)], "x string")
    assert sorted(r["x"] for r in rows.append(a, b, "s", force=True).collect()) == ["1", "q"]


def test_fuzzy(spark):
    a = spark.createDataFrame([("Alice Smith",), ("Bob Jones",), ("zzz",)], "n string")
    b = spark.createDataFrame([("Alice Smyth",), ("Rob Jones",), ("unlike",)], "n string")
    got = {r["a"]: r["matched"] for r in fuzzy.fuzzy_match(a, b, "n", 0.8, "editdistance").collect()}
    assert got == {"Alice Smith": "Alice Smyth", "Bob Jones": "Rob Jones"}
    scored = fuzzy.fuzzy_score(a, b, "n", 80)
    assert scored.filter("_merge = 1").count() == 1
    same = fuzzy.fuzzy_match(a, a, "n", 0.99)
    assert same.filter("a <> matched").count() == 0 and same.count() == 3


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    path = str(tmp_path / "t")
    files.save(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        files.save(df, path)
    files.save(df, path, replace=True, where=F.col("x") > 1)
    assert files.use(spark, path).count() == 1
    pdf = df.toPandas()
    pdf.to_stata(str(tmp_path / "a.dta"), write_index=False, variable_labels={"x": "a number"})
    dta = files.read_dta(spark, str(tmp_path / "*.dta"), "x int, y string")
    assert dta.count() == 2
    assert C.labels(files.labelled(dta, files.dta_labels(spark, str(tmp_path / "*.dta"))))["x"]["label"] == "a number"


def test_html(spark):
    page = "<table><tr><td>a</td></tr></table><TABLE><tr><th>h<th>i</tr><tr><td>1 <b>x</b></td><td>2</table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "no")], "page_id int, html string")
    got = html.largest_table(html.html_tables(df)).orderBy("row_idx").collect()
    assert [r["cells"] for r in got] == [["h", "i"], ["1 x", "2"]]


def test_distributions():
    assert math.isclose(D.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(D.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(D.f_upper(4.964602743730711, 1, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(D.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-9)
    assert math.isclose(D.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert D.binomial_quantile(0.5, 10, 0.5) == 5 and math.isclose(D.binomial_cdf(3, 10, 0.5), 176 / 1024)


def test_summaries_of_text(spark):
    body = "The storm hit the coast. The storm destroyed many coast houses near the storm wall. Birds sing. Nobody knew why."
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, t string")
    assert text.luhn(df, "id", "t", 1).first()["summary"].startswith("The storm destroyed")
    for f in (text.sumbasic, text.kl_sum):
        assert f(df, "id", "t", 2).filter("id = 1").count() == 1
    for m in ("lexrank", "textrank"):
        assert "storm" in text.rank_summary(df, "id", "t", 1, m).filter("id = 1").first()["summary"]
