"""Labels by TF-IDF cosine, against dictionaries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from tabulon.operators import text


def _plain(docs, labels, threshold):
    words = lambda x: Counter(re.findall(r"[^\W\d_]+", (x or "").lower()))
    tf = {i: words(x) for i, x in docs}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(tf)) / (1 + k)) + 1 for w, k in df.items()}
    out = {}
    for i, c in tf.items():
        x = {w: k * idf[w] for w, k in c.items()}
        best = []
        for name, about in labels:
            z = {w: k * idf.get(w, 1.0) for w, k in words(about).items()}
            if set(x) & set(z):
                d = sum(x[w] * z[w] for w in set(x) & set(z))
                score = round(d / math.sqrt(sum(v * v for v in x.values())) / math.sqrt(sum(v * v for v in z.values())), 9)
                if score >= threshold:
                    best.append((-score, name))
        out[i] = (min(best)[1], -min(best)[0]) if best else (None, None)
    return out


def test_classify_equals_dictionaries(spark):
    r = random.Random(2)
    vocabulary = ["sun", "rain", "Schnee", "été", "wind", "ice", "fog", "sky"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 20)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "12 34"), (93, "unseen words"), (94, "sun " * 5000), (95, docs[0][1]), (96, "sun rain")]
    # two labels of the same words tie, one has no word, one words that no document has
    labels = [("b", "sun rain"), ("a", "rain sun"), ("cold", "ice Schnee fog"), ("none", "..."), ("other", "volcano ice"), ("season", "ÉTÉ wind")]
    df = spark.createDataFrame(docs, "id long, t string")
    lab = spark.createDataFrame(labels, "label string, description string")
    for threshold in (0.0, 0.6):
        got = {x["id"]: (x["v_class"], x["v_score"]) for x in text.classify(df, "id", "t", lab, threshold).collect()}
        want = _plain(docs, labels, threshold)
        assert got.keys() == want.keys()
        for i in want:
            assert got[i][0] == want[i][0], i
            assert (got[i][1] is None) == (want[i][1] is None) and math.isclose(got[i][1] or 0, want[i][1] or 0, abs_tol=1e-8), i
    assert want[96][0] == got[96][0] == "a" and got[90] == (None, None)
    assert text.classify(df.limit(0), "id", "t", lab).count() == 0


def _most_rows(plan):
    """The most rows that a node of an executed plan made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    own = plan.metrics().get("numOutputRows")
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([own.get().value() if own.isDefined() else 0, *map(_most_rows, below)])


def test_texts_are_not_paired_with_all_labels(spark):
    docs = [(i, f"shared also here {'abcdefgh'[i % 8]}x") for i in range(300)]
    labels = [(f"l{k:03d}", f"shared also here {'abcdefgh'[k % 8]}x " + "pad " * (k // 8)) for k in range(200)]
    df, lab = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(labels, "label string, description string")
    got = text.classify(df, "id", "t", lab)
    assert {r["id"]: r["v_class"] for r in got.collect()} == {i: name for i, (name, _) in _plain(docs, labels, 0.0).items()}
    assert _most_rows(got._jdf.queryExecution().executedPlan()) <= 20 * len(docs)  # 300 x 200 pairs share words


def test_rows_of_one_id_share_a_score(spark):
    lab = spark.createDataFrame([("a", "sun rain"), ("b", "ice fog"), ("c", "wind")], "label string, description string")
    rows = [(1, "sun rain sun"), (1, "sun rain sun"), (2, "sun ice"), (2, "ice fog fog"), (3, "sun rain sun"), (4, None), (4, "wind"), (None, "wind")]
    got = sorted((r["id"] or 0, r["v_class"], r["v_score"]) for r in text.classify(spark.createDataFrame(rows, "id long, t string"), "id", "t", lab).collect())
    assert [x[:2] for x in got] == [(0, None), (1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "a"), (4, "c"), (4, "c")]
    assert got[1][2] == got[2][2] == got[5][2]
