"""Odd rows: nulls, empty and long texts, repeats, no rows, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabulon.llm import language_model, pii, quality, simhash, toxicity

LONG = " ".join(f"word{k % 500}" for k in range(20_000))
ROWS = [
    (1, "a plain text of words"),
    (1, "a plain text of words"),
    (2, None),
    (3, ""),
    (None, "nobody's text"),
    (None, None),
    (4, LONG),
    (5, "\t\r \x0b"),
]
CLASH = ["n_tokens", "fp", "score", "held_out", "failed", "piece", "w", "ids", "chunk", "label", "toxic", "component_id", "_row"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.create_map(F.lit("k"), F.lit(c)) for c in CLASH})


def fitted(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    return toxicity.score(docs, toxicity.fit(docs, labels))


OPERATORS = {
    "language_model": language_model.score_documents,
    "toxicity": fitted,
    "simhash": simhash.near_duplicates,
    "quality": quality.ledger,
    "pii": lambda docs: pii.find_and_replace(docs, key="k"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_row_for_a_row(odd, name):
    got = OPERATORS[name](odd).select("doc_id").collect()
    ids = lambda rows: sorted(str(r[0]) for r in rows)
    assert ids(got) == ids(ROWS)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_equal_rows_get_equal_results(odd):
    for name, column in (("language_model", "score"), ("toxicity", "score"), ("simhash", "fp"), ("quality", "failed")):
        got = OPERATORS[name](odd).filter("doc_id = 1").select(column).collect()
        assert len(got) == 2 and got[0] == got[1], name


def test_scores_of_empty_texts(odd):
    scores = {(r["doc_id"], r["n_tokens"]): r["score"] for r in OPERATORS["language_model"](odd).collect()}
    assert scores[2, 1] < 0 and scores[3, 1] < 0  # the end alone
    assert scores[4, 20_001] < scores[3, 1]
    assert all(0 <= r["score"] <= 1 for r in OPERATORS["toxicity"](odd).collect())
