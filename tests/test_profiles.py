"""Codes, profiles, ranks, samples and files."""

from __future__ import annotations

import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import columns, joins, quantiles, rows, summary, text, windows
from tabulon.sources import files


@pytest.fixture(scope="module")
def people(spark):
    r = np.random.default_rng(3)
    data = [(i, "abc"[i % 3] if i % 7 else None, float(x) if i % 5 else None) for i, x in enumerate(r.integers(0, 40, 200))]
    return spark.createDataFrame(data, "i long, g string, x double"), data


def test_codes_carry_value_labels(people):
    df, _ = people
    out = columns.encode(df, "g", "code")
    assert out.schema["code"].metadata["value_labels"] == {"1": "a", "2": "b", "3": "c"}
    back = columns.decode(out, "code", "text")
    assert back.filter("NOT (text <=> g)").count() == 0
    assert columns.compress(df).schema["g"].metadata["categories"] == ["a", "b", "c"]


def test_profile_of_columns(people):
    df, data = people
    got = {r["variable"]: r for r in summary.codebook(columns.with_label(df, "x", "points"), "g", "x").collect()}
    x = [v for _, _, v in data if v is not None]
    assert got["x"]["label"] == "points" and got["x"]["n"] == len(x) and got["x"]["missing"] == 200 - len(x)
    assert np.isclose(got["x"]["mean"], np.mean(x)) and np.isclose(got["x"]["sd"], statistics.stdev(x)) and got["x"]["p75"] == np.quantile(x, 0.75)
    often = sorted(Counter(g for _, g, _ in data if g).items(), key=lambda kv: (-kv[1], kv[0]))
    assert got["g"]["top"] == "; ".join(f"{v} ({k})" for v, k in often) and got["g"]["mean"] is None
    freq = [r["freq"] for r in summary.tab1(df, "x", sort=True).orderBy("cum").collect()]
    assert freq == sorted(freq, reverse=True)


def test_quantiles_and_ranks_over_all_and_by_group(people):
    df, data = people
    for by in ([], ["g"]):
        got = {(r["g"] if by else None, r["p"]): r["q"] for r in quantiles.quantile7(df, ["x"], [0.1, 0.5, 1.0], by).collect()}
        for key in {k for k, _ in got}:
            x = [v for _, g, v in data if v is not None and (not by or g == key)]
            assert all(np.isclose(got[key, p], np.quantile(x, p)) for p in (0.1, 0.5, 1.0))
        ranked = windows.rank(df.repartition(4), "r", "x", by)
        x = np.array([v for _, g, v in data if v is not None and (not by or g == "a")])
        own = {r["x"]: r["r"] for r in ranked.filter("x IS NOT NULL" + (" AND g = 'a'" if by else "")).collect()}
        assert all(own[v] == (x < v).sum() + ((x == v).sum() + 1) / 2 for v in x)
        assert ranked.filter("x IS NULL AND r IS NOT NULL").count() == 0 and ranked.count() == 200


def test_samples_do_not_follow_the_partitions(people):
    df, _ = people
    df = df.withColumn("m", F.create_map(F.lit("k"), F.col("g")))
    a, b = (sorted(r["i"] for r in rows.sample_rows(df.repartition(n), 50, 7).collect()) for n in (1, 5))
    assert a == b and len(set(a)) == 50
    assert a != sorted(r["i"] for r in rows.sample_rows(df, 50, 8).collect())
    same = df.select(F.lit(1).alias("one"))
    assert rows.sample_rows(same, 30).count() == 30 and rows.sample_rows(same, 500).count() == 200 and rows.sample_rows(same, 0).count() == 0


def test_merges_by_how_and_bounded_grids(people):
    df, _ = people
    right = df.sparkSession.createDataFrame([("a", 1), ("z", 2), (None, 3)], "g string, y int")
    n = {h: joins.merge_how(df.limit(30), right, ["g"], h).groupBy("_merge").count().collect() for h in ("inner", "left", "right", "outer")}
    codes = {h: sorted(r["_merge"] for r in v) for h, v in n.items()}
    assert codes == {"inner": [3], "left": [1, 3], "right": [2, 3], "outer": [1, 2, 3]}
    with pytest.raises(ValueError):
        joins.fillin(df, "i", "x", most=100)


def test_encodings_are_found(spark, tmp_path):
    for name, kind in (("utf-8", "utf-8"), ("latin-1", "ISO-8859-1")):
        (tmp_path / name).write_bytes("name,n\nJosé,1\nZoë,2\n".encode(name))
        assert files.encoding_of(spark, f"file://{tmp_path}/{name}") == kind
        assert [r["name"] for r in files.import_delimited(spark, f"file://{tmp_path}/{name}").collect()] == ["José", "Zoë"]


def test_sentences_and_lengths_of_summaries(spark):
    t = "Élan vital. ça va. 3 more! ¿Quien? no capital here. End"
    df = spark.createDataFrame([(1, t), (2, "small words. all small! yes"), (3, None), (4, "")], "id long, t string")
    got = {}
    for r in text.sentences(df, "id", "t").orderBy("id", "k").collect():
        got.setdefault(r["id"], []).append(r["sentence"])
    assert got == {1: ["Élan vital. ça va.", "3 more!", "¿Quien? no capital here.", "End"], 2: ["small words.", "all small!", "yes"]}
    many = spark.createDataFrame([(1, " ".join(f"Sentence {w} has words." for w in "abcdefgh"))], "id long, t string")
    assert text.luhn(many, "id", "t", maxlen=120).first()["summary"].count(".") == 3
    body = "One cat and dog. Dog and cat and dog again. Nothing here now. A cat sat. The dog dog ran off."
    best = text.luhn(spark.createDataFrame([(1, body)], "id long, t string"), "id", "t", 1).first()["summary"]
    assert best == "The dog dog ran off."  # 2 * 2 / 2 against 3 * 3 / 5
