"""Fuzzy merges against all pairs without blocking."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tabulon.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.6, 0.75, 0.8, 0.9, 1.0])
def test_edit_pairs_finds_every_pair(spark, threshold):
    names = ["peter", "pefer", "james", "jazes", "abcd", "abxcd", "abcdefgh", "abxdeygh", "", "a", "b", "ab", "ba", "Peter", "ünïcode", "unïcode", "aaaaaa", "aaaaab", "hot ring", "ht ring", "abcdefghijklmno", "abcxefgxijklxno"]
    df = spark.createDataFrame([(x,) for x in [*names, None, "peter"]], "s string")
    alike = lambda a, b: round(1 - distance(a, b) / max(len(a), len(b), 1), 9)
    want = {(a, b): alike(a, b) for a in names for b in names if alike(a, b) >= threshold}
    got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in fuzzy.edit_pairs(df, df, "s", threshold).collect()}
    assert {k: v for k, v in got.items() if v >= threshold} == want


def test_fuzzy_keeps_short_names(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "s string") for v in (["peter", "james", "abcd"], ["pefer", "jazes", "abxcd"]))
    assert fuzzy.fuzzy_merge(a, b, "s", 0.8, "editdistance").filter("s_matched IS NULL").count() == 0
    assert fuzzy.fuzzy_score(a, b, "s", 80).filter("_merge = 1").count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8])
def test_prefixes_lose_no_pair(spark, threshold):
    """Against all pairs; every string holds one common word."""
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    names = sorted({"company " + " ".join(r.choice(words) + r.choice(["", "s", "x"]) for _ in range(r.randint(1, 3))) for _ in range(160)})
    a, b = (spark.createDataFrame([(x,) for x in part], "n string") for part in (names[::2], names[1::2]))
    grams = {x: {x[i : i + 3] for i in range(max(len(x) - 2, 1))} for x in names}
    df = Counter(g for gs in grams.values() for g in gs)
    w = {g: math.log((1 + len(names)) / (1 + n)) + 1 for g, n in df.items()}
    norm = {x: math.sqrt(sum(w[g] ** 2 for g in gs)) for x, gs in grams.items()}
    all_pairs = {(x, y): sum(w[g] ** 2 for g in grams[x] & grams[y]) / norm[x] / norm[y] for x in names[::2] for y in names[1::2]}
    want = {p: s for p, s in all_pairs.items() if round(s, 9) >= threshold}
    got = {(r["a"], r["b"]): r["similarity"] for r in fuzzy.tfidf_pairs(a, b, "n", threshold=threshold).collect()}
    assert all(got[p] == pytest.approx(s, abs=1e-12) for p, s in want.items()) and want
    assert all(got[p] == pytest.approx(all_pairs[p], abs=1e-12) for p in got)
    if threshold == 0.8:  # all strings share an n-gram, few pairs are compared
        assert len(got) < len(all_pairs) / 3
    assert len(fuzzy.tfidf_pairs(a, b, "n").collect()) == len(all_pairs)
