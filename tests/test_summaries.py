"""Summaries of whole documents, against brute force."""

from __future__ import annotations

import itertools
import math
import re
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry
from tabulon.operators import text

WORD = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]+")
SPACE = r"[ \t\n\x0b\f\r]+"


def sentences(t):
    t = re.sub(rf"^{SPACE}|{SPACE}$", "", t or "")
    got = re.split(rf"(?<=[.!?]){SPACE}(?=[A-ZÀ-ɏЀ-ӿ])", t)
    got = got if len(got) > 1 else re.split(rf"(?<=[.!?]){SPACE}", t)
    return [s.strip(" ") for s in got if s.strip(" ")]


def sumbasic(bags, n):
    count = Counter(itertools.chain(*bags))
    p = {w: c / count.total() for w, c in count.items()}
    out = []
    for _ in range(min(n, len(bags))):
        key = lambda k: (not bags[k], -round(sum(p[w] for w in bags[k]) / max(len(bags[k]), 1), 12), k)  # noqa: B023, E731
        out.append(min(set(range(len(bags))) - set(out), key=key))
        for w in set(bags[out[-1]]):
            p[w] **= 2
    return out


def kl_sum(bags, n):
    doc = Counter(itertools.chain(*bags))
    out = []

    def key(k):
        have = Counter(itertools.chain(*(bags[i] for i in [*out, k])))
        kl = sum(c / have.total() * math.log(c / have.total() / (doc[w] / doc.total())) for w, c in have.items())
        return not bags[k], round(kl, 12), k

    for _ in range(min(n, len(bags))):
        out.append(min(set(range(len(bags))) - set(out), key=key))
    return out


def ranked(bags, n, method):
    size, df = len(bags), Counter(w for b in bags for w in set(b))
    if method == "lexrank":
        vec = [{w: c * (math.log(size / df[w]) + 1) for w, c in Counter(b).items()} for b in bags]
        norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
        edge = lambda a, b: float(sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) > 0.1 * norm[a] * norm[b])
    else:
        own = [set(b) for b in bags]
        edge = lambda a, b: len(own[a] & own[b]) / (math.log(len(own[a]) * len(own[b])) or math.inf) if own[a] & own[b] else 0.0
    e = [[edge(a, b) if a != b else 0.0 for b in range(size)] for a in range(size)]
    out, rank = [sum(row) for row in e], [1.0] * size
    for _ in range(20):
        rank = [0.15 + 0.85 * sum(rank[a] * e[a][b] / out[a] for a in range(size) if e[a][b]) for b in range(size)]
    return sorted(range(size), key=lambda k: (-round(rank[k], 9), k))[:n]


PICK = {"n1_sumbasic": sumbasic, "n1_kl_sum": kl_sum, "n2_lexrank": lambda b, n: ranked(b, n, "lexrank"), "n2_textrank": lambda b, n: ranked(b, n, "textrank")}


def brute(t, name, n=2):
    s = sentences(t)
    stop = set(text.STOP_WORDS["english"].split())
    bags = [[w for w in WORD.findall(x.lower()) if w not in stop] for x in s]
    return " ".join(s[k] for k in sorted(PICK[name](bags, n)))


@pytest.mark.parametrize("name", list(PICK))
def test_summaries_of_all_documents(spark, sf, name):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["summary"] for r in entry.queries()[name](spark, sf).collect()}
    assert set(got) == {i for i, t in docs.items() if sentences(t)}
    few = {i: t for i, t in docs.items() if i in got and len(sentences(t)) <= 150}
    assert len(few) > 150
    assert {i: got[i] for i in few} == {i: brute(t, name) for i, t in few.items()}


@pytest.mark.parametrize("name", list(PICK))
def test_odd_documents(spark, name):
    long = " ".join(f"W{chr(97 + i % 7) * (1 + i % 5)} x{chr(97 + i % 11)} y{chr(97 + i * i % 13)} common." for i in range(1100))
    rows = [(1, None), (2, ""), (3, "The of and. It is the. They were."), (4, "12. 34. Storm hit it. Storm."), (None, "No id here."), (5, long), (4, "One id twice. Storm.")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(2)
    f = {"n1_sumbasic": text.sumbasic, "n1_kl_sum": text.kl_sum}.get(name) or (lambda *a: text.rank_summary(*a, name[3:]))
    got = sorted((r["id"] or 0, r["summary"]) for r in f(df, "id", "t", 2).collect())
    assert got == sorted((i or 0, brute(t, name)) for i, t in rows if sentences(t))


def test_strips_give_the_same_ranks(spark, monkeypatch):
    body = " ".join(f"W{chr(97 + i % 7)} x{chr(97 + i % 11)} y{chr(97 + i * i % 13)}." for i in range(40))
    df = spark.createDataFrame([(1, body)], "id int, t string")
    for m in ("lexrank", "textrank"):
        whole = text.rank_summary(df, "id", "t", 5, m).first()["summary"]
        held, strip = text.HELD, text.STRIP
        monkeypatch.setattr(text, "HELD", 10)
        monkeypatch.setattr(text, "STRIP", 100)
        assert text.rank_summary(df, "id", "t", 5, m).first()["summary"] == whole
        monkeypatch.setattr(text, "HELD", held)
        monkeypatch.setattr(text, "STRIP", strip)


def test_python_holds_few_sentences_at_once(spark):
    body = " ".join(f"Word{chr(97 + i % 23)}{'abcdefgh' * 5} other{chr(97 + i % 7)}{'ijkl' * 5}." for i in range(40))
    df = spark.range(6000, numPartitions=1).selectExpr("id", f"concat('Begin', repeat('x', int(id % 7)), ' here. {body}') AS t")

    def pick(k, w, at, size, n):
        assert sys._getframe(1).f_locals["batch"].nbytes < 12 << 20
        return [0, size - 1]

    got = text._summaries(df, "id", "t", 2, "english", pick).collect()
    last = body.split(". ")[-1]
    assert sorted(r["id"] for r in got) == list(range(6000))
    assert {r["id"] % 7: r["summary"] for r in got} == {k: f"Begin{'x' * k} here. {last}" for k in range(7)}


def test_a_document_over_many_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([(1, "Sun. Rain."), (2, " ".join(f"Sun w{chr(97 + i % 26)}." for i in range(50))), (2, "Snow. Ice. Snow fell."), (3, None), (4, "Fog.")], "id int, t string").coalesce(1)
    f = lambda: [tuple(r) for r in text.luhn(df, "id", "t", 2).collect()]
    want, was = f(), spark.conf.get(key)
    try:
        for size in (1, 3, 7):
            spark.conf.set(key, str(size))
            assert f() == want
    finally:
        spark.conf.set(key, was)
    assert [x[0] for x in want] == [1, 2, 2, 4]
