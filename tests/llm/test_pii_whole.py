"""Personal data that stands alone or beside other tokens."""

from __future__ import annotations

import pytest

from tabulon.llm import pii


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for _, r in sorted((r["doc_id"], r) for r in pii.find_and_replace(df, "k").collect())]


def test_addresses_of_single_digits(spark):
    alone, beside = found(spark, ["ask 8.8.8.8 first", "ask 8.8.8.8 first, in 12 days"])
    assert alone["n_ip"] == beside["n_ip"] == 1
    assert "8.8.8.8" not in alone["text"] and beside["text"] == alone["text"] + ", in 12 days"


VALUES = [
    ("AT61 1904 3002 3457 3201", " BIC", "iban"),
    ("AT611904300234573201", " EUR", "iban"),
    ("ES91 2100 0418 4502 0005 1332", " 2024", "iban"),
    ("PL61 1090 1014 0000 0712 1981 2874", " PLN", "iban"),
    ("HU42 1177 3016 1111 1018 0000 0000", " HUF", "iban"),
    ("SE45 5000 0000 0583 9825 7466", " SEK", "iban"),
    ("NO93 8601 1117 947", " NOK", "iban"),
    ("4111 1111 1111 1111", " 123", "card"),
    ("+49 1512 345 6789", " 1234 5678", "phone"),
]


@pytest.fixture(scope="module")
def both(spark):
    texts = [f"pay {v}{t}" for v, after, _ in VALUES for t in ("", after)]
    return found(spark, [*texts, "ref AB12 4111 1111 1111 1111 ok", "no 4111 1111 1111 1112 123, 999.1.1.1, 2023-13-45"])


def test_values_before_short_tokens(both):
    for i, (value, after, kind) in enumerate(VALUES):
        alone, beside = both[2 * i], both[2 * i + 1]
        assert value not in alone["text"] and alone[f"n_{kind}"] == 1, value
        if kind == "phone":  # a longer run of groups may be a number too
            assert value not in beside["text"] and beside["n_phone"] == 1
        else:
            assert (beside["text"], beside[f"n_{kind}"], beside["n_found"]) == (alone["text"] + after, 1, 1), value


def test_values_inside_candidates(both):
    assert "4111 1111 1111 1111" not in both[-2]["text"] and both[-2]["text"].startswith("ref AB12 ") and both[-2]["n_card"] == 1
    assert both[-1]["text"] == "no 4111 1111 1111 1112 123, 999.1.1.1, 2023-13-45" and both[-1]["n_found"] == 0
