"""Values that must not stay in clear text, and prose that must."""

from __future__ import annotations

import datetime
import ipaddress

import pytest

from tabulon.llm import pii

SECRETS = {
    "Password=SuperSecret1234": "SuperSecret1234",
    "API_KEY=abcdefgh12345678": "abcdefgh12345678",
    "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY": "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    '{"token": "abcdefgh12345678"}': "abcdefgh12345678",
    "{'client_secret':'Zz9-zz'}": "Zz9-zz",
    "password=hunter2": "hunter2",
    "password: Abc!defghijklmn": "Abc!defghijklmn",
    "db.passwd = tr0ub4dor&3": "tr0ub4dor",
    "TOKEN: Quiet": "Quiet",
    "my-api-key : 12/31/1999": "12/31/1999",
}
VALUES = {
    "on 12/31/1999 we": ("12/31/1999", "date"),
    "on 02/29/2004 we": ("02/29/2004", "date"),
    "by 1999/12/31.": ("1999/12/31", "date"),
    "born 1899-05-01": ("1899-05-01", "date"),
    "in 2150-05-01 maybe": ("2150-05-01", "date"),
    "card 3782-822463-10005": ("3782-822463-10005", "card"),
    "to de89370400440532013000 now": ("de89370400440532013000", "iban"),
    "to gb29 nwbk 6016 1331 9268 19": ("gb29 nwbk 6016 1331 9268 19", "iban"),
    "from 2001:db8::8a2e:370:7334 on": ("2001:db8::8a2e:370:7334", "ip"),
    "from fe80::1 and": ("fe80::1", "ip"),
    "from 2001:0db8:0000:0000:0000:8a2e:0370:7334 on": ("2001:0db8:0000:0000:0000:8a2e:0370:7334", "ip"),
    "call 030 12345678 soon": ("030 12345678", "phone"),
}
PROSE = [
    "The secret: patience and time.", "A token: one coin, a password: nothing.", "std::vector and Bad::Face at 12:30:45", "ratio 3:4, chapter 12",
    "no date 13/13/1999 nor 1999-13-01 nor 02/30/2000", "de11 word that goes here", "0 12345678", "passwords are long", "the token", "secrets; keys", "year 0050-01-01",
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [*SECRETS, *VALUES, *PROSE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return dict(zip(texts, sorted(pii.find_and_replace(df, "k").collect()), strict=True))


def test_no_secret_stays(found):
    for text, value in SECRETS.items():
        assert value not in found[text]["text"] and found[text]["n_found"] == 1, text
        assert len(found[text]["text"]) == len(text)


def test_values_of_each_format_are_moved_within_it(found):
    for text, (value, kind) in VALUES.items():
        r = found[text]
        assert value not in r["text"] and r[f"n_{kind}"] == r["n_found"] == 1, text
        before, after = text.split(value)
        assert r["text"].startswith(before) and r["text"].endswith(after)
        new = r["text"][len(before) : len(r["text"]) - len(after)]
        if kind == "date":
            form = {"/": "%Y/%m/%d" if value[4] == "/" else "%m/%d/%Y", "-": "%Y-%m-%d"}["/" if "/" in value else "-"]
            datetime.datetime.strptime(new, form)
            assert form != "%m/%d/%Y" or int(new[3:5]) > 12
        if ":" in value:
            ipaddress.ip_address(new)
        if kind == "phone":
            assert new[0] == "0"


def test_spellings_of_an_address_are_linked(found):
    a, b = (found[t]["text"].split()[1] for t in VALUES if "7334" in t)
    assert a == b


def test_prose_stays(found):
    for text in PROSE:
        assert found[text]["text"] == text and found[text]["n_found"] == 0, text


def test_month_first_dates_never_meet(spark):
    days = [datetime.date(1996, 1, 1) + datetime.timedelta(k) for k in range(1500)]
    rows = [(k, d.strftime("%m/%d/%Y")) for k, d in enumerate(days)]
    got = {r["text"] for r in pii.find_and_replace(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()}
    assert len(got) == len(rows)
