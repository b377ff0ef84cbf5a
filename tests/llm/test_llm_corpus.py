"""Corpus-wide training-data operators against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import language_model, linededup, queries, simhash, toxicity, warc


def documents(seed=1, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(80)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [[line(12) for _ in range(6)] for _ in range(4)]
    out = []
    for i in range(n):
        lines = [line(r.randint(0, 15)) for _ in range(r.randint(1, 8))]
        if i % 3 == 0:
            k = r.randrange(4)
            lines[1:1] = shared[k][r.randint(0, 1) : r.randint(3, 6)]
        if i % 10 == 0:
            lines += ["same line here"] * 3
        out.append((i, "\n".join(lines)))
    out += [(n, None), (n + 1, ""), (n + 2, out[5][1]), (n + 3, out[5][1]), (n + 4, "\n".join(["rep eat " * 10] * 9))]
    return out


def brute_lines(rows, least):
    """Later copies by the longest match with any earlier place."""
    docs = [(i, t.split("\n")) for i, t in sorted(r for r in rows if r[1] is not None)]
    where: dict = {}
    for d, (_, ls) in enumerate(docs):
        for k, x in enumerate(ls):
            where.setdefault(x, []).append((d, k))
    gone = {i: set() for i, _ in docs}
    for d, (i, ls) in enumerate(docs):
        for k, x in enumerate(ls):
            for e, j in where[x]:
                if (e, j) >= (d, k):
                    break
                m, other = 0, docs[e][1]
                while k + m < len(ls) and j + m < len(other) and ls[k + m] == other[j + m]:
                    m += 1
                if sum(len(y.split()) for y in ls[k : k + m]) >= least:
                    gone[i] |= set(range(k, k + m))
    return {i: "\n".join(x for k, x in enumerate(ls) if k not in gone[i]) for i, ls in docs}


@pytest.mark.parametrize("least", [20, 50])
def test_line_dedup_matches_brute_force(spark, least):
    rows = documents()
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, line string")
    got = linededup.drop_repeated_lines(df, least)
    assert got.columns[:3] == df.columns
    found = {r["doc_id"]: r["text"] for r in got.collect()}
    assert found.pop(120) is None and found == brute_lines(rows, least)
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0
    clash = df.withColumns({"n_lines": F.lit("x"), "spans": F.lit(None), "row": F.lit(1), "th": F.lit(2)})
    again = linededup.drop_repeated_lines(clash, least)
    assert {r["doc_id"]: r["text"] for r in again.collect() if r["text"] is not None} == found
    assert dict(again.dtypes)["n_lines"] == "bigint" and "row" in again.columns
    nameless = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert linededup.drop_repeated_lines(nameless, least).count() == df.count()


def near(rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {i: fp(t) for i, t in rows}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (fps[i], root(i)) for i in ids}


@pytest.mark.parametrize("tile", [2048, 8])
def test_simhash_matches_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = documents(2)
    base = " ".join(f"w{k}" for k in range(300))
    rows += [(1000 + k, base + f" tail{k}") for k in range(40)] + [(2000, "One two"), (2001, "one TWO"), (2002, "é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == near(rows)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {c for _, c in got.values()}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_bit_sliced_distances():
    r = np.random.default_rng(3)
    v = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    v[250:] = v[:250] ^ (np.uint64(1) << r.integers(0, 63, 250).astype(np.uint64))
    v = np.unique(v)
    u, w = simhash.forest(v, 3)
    assert (np.bitwise_count(u ^ w) >= 0).all() and len(u) == 250
    a, b = simhash._pairs_of_small([v[:40], v[40:60]], 3)
    d = lambda x: sum(int(np.bitwise_count(x[i] ^ x[j]) <= 3) for i in range(len(x)) for j in range(i))
    assert len(a) == d(v[:40]) + d(v[40:60])


def test_language_model_base_is_exact_and_model_is_better(spark):
    rows = documents(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score_documents(df).collect()}
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and math.isfinite(r["score"])
    total = lambda k: sum(r[k] for r in got.values() if r["held_out"])
    assert total("score") > total("base_score") * 1.05
    assert language_model.score_documents(df.limit(0)).count() == 0


def test_weights_follow_the_held_out_counts():
    cells = [(3, 100.0, 0.5, 0.001), (0, 50.0, 0.0, 0.01)]
    w = language_model.learn_weights(cells, 1000)
    assert w[3, 0] > 0.9 and w[0, 1] > 0.9 and np.allclose(w.sum(axis=1), 1)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "<p>one</p>"), (2, None, None), (3, "http://b", ""), (5, "http://c", "<p>one</p>"), (4, "u", "WARC/1.1\r\n\r\n\r\né"), (5, "http://c", "<p>one</p>")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(warc.round_trip(df).collect(), key=lambda r: r["record_type"], reverse=True)
    assert sorted(r["metadata"]["fields"]["page-id"] for r in got) == ["1", "2", "3", "4", "5", "5"]  # a record a row
    assert [r["record_type"] for r in got if r["metadata"]["fields"]["page-id"] == "5"] == ["revisit", "response"]
    out = {r["metadata"]["fields"]["page-id"]: r for r in got}
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    for i, _, html in rows:
        r = out[str(i)]
        assert r["digest"] == sha(html) and r["payload_bytes"] == len((html or "").encode())
        assert r["request"]["target_uri"] == r["response"]["target_uri"]
    assert out["1"]["record_type"] == "revisit" and out["1"]["original"]["page-id"] == "5"
    assert out["2"]["record_type"] == "revisit" and out["2"]["original"]["page-id"] == "3"
    assert out["4"]["record_type"] == out["5"]["record_type"] == "response"
    assert warc.round_trip(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, u, "") for u in ("a", "a", "b", None)], "page_id long, url string, html string")
    kept = warc.round_trip(nameless).collect()
    assert sorted(str(r["response"]["target_uri"]) for r in kept) == ["None", "a", "a", "b"]
    assert [r["response"]["target_uri"] for r in kept if r["record_type"] == "response"] == ["b"]


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(r.randint(0, 9)) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[3:3] = r.sample(["vile", "scum", "trashy", "moronic", "idiotic"], 2)
        rows.append((i, " ".join(x.rstrip("0123456789") + "x" * (k % 3) for k, x in enumerate(w))))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == bool(y) for i, y in held)
    assert right / len(held) > 0.97 and 0 <= got[1000] < 0.3 and got[1001] == got[1000]
    none = toxicity.fit(docs, lab.filter("toxic = 0"))
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") > 10, F.col("doc_id")))
    assert toxicity.score(nameless, toxicity.fit(nameless, lab)).count() == docs.count()
    assert none is None and {x["score"] for x in toxicity.score(docs, none).collect()} == {0.0}


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).persist()
        assert set(kept.columns) == set(docs.columns)
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > 0
    # brute force of the stages after the rules
    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality_stage(spark, docs, sf).collect()]
    left = {i: t for i, t in brute_lines(rows, linededup.MIN_WORDS).items() if t != "" or dict(rows)[i] == ""}
    found = near(list(left.items()))
    left = {i: t for i, t in left.items() if found[i][1] == i}
    from tests.llm.test_llm_text import brute_hits

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if brute_hits(t, items)[1] == 0}
    assert left == {r["doc_id"]: r["text"] for r in kept.collect()}
    done = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in done.select("doc_id").collect()} == set(left)


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]


def test_unused_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, fp string").withColumn("x", F.lit(None))
    assert simhash.near_duplicates(df).count() == 1


def test_language_model_score_matches_deleted_interpolation(spark):
    """The model's score from plain counters and a plain expectation-maximisation."""
    rows = documents(6, 60) + [(None, "no id here"), (7, "same id again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fold": F.lit(1), "chunk": F.lit("x")})
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in language_model.score_documents(df).collect())
    fold = lambda i: language_model.fold_of(i)
    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]

    def counts(folds):
        uni, pair = Counter(), Counter()
        for i, ws in toks:
            if fold(i) in folds:
                uni.update(ws)
                pair.update(zip(["start", *ws[:-1]], ws, strict=True))
        uni["start"] = uni[None]
        return uni, pair

    def estimates(ws, uni, pair, n):
        for h, w in zip(["start", *ws[:-1]], ws, strict=True):
            b = int(math.log2(uni[h])) + 1 if uni[h] else 0
            yield b, pair[h, w] / max(uni[h], 1), uni[w] / n

    rest, both = counts([language_model.REST]), counts([language_model.REST, language_model.EM_FOLD])
    n_rest, n_both = (sum(v for k, v in u.items() if k != "start") for u, _ in (rest, both))
    v = sum(c > 0 for k, c in both[0].items() if k != "start")
    held = [x for i, ws in toks if fold(i) == language_model.EM_FOLD for x in estimates(ws, *rest, n_rest)]
    weights = {b: np.array([0.5, 0.4, 0.1]) for b in range(65)}
    for _ in range(language_model.EM_ROUNDS):
        total = {b: np.full(3, 0.01) for b in weights}
        for b, f2, f1 in held:
            share = weights[b] * [f2, f1, 1 / (v + 1)]
            total[b] += share / share.sum()
        new = {b: x / x.sum() for b, x in total.items()}
        done = max(np.abs(new[b] - weights[b]).max() for b in new) < 1e-7
        weights = new
        if done:
            break
    want = sorted((str(i), len(ws), sum(math.log10(weights[b] @ [f2, f1, 1 / (v + 1)]) for b, f2, f1 in estimates(ws, *both, n_both))) for i, ws in toks)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    # the operator adds held-out estimates up in cells of a quarter of a factor of two
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=2e-3)


def test_near_duplicates_of_repeated_and_nameless_rows(spark):
    rows = [(5, "one text of words"), (5, "another text of other words"), (5, "one text of words"), (None, "one text of words"), (9, "one text of words"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1), "void": F.lit(None)})
    assert simhash.near_duplicates(df).count() == 6
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("5", rows[0][1]), ("5", rows[1][1]), ("None", rows[0][1]), ("9", "None")])


def test_pipeline_stages_on_odd_rows(spark, sf):
    good = " ".join(f"Word{k} and more text" for k in range(30)) + "."
    rows = [(1, good, "own"), (1, good, "own"), (2, None, "own"), (3, "", None), (None, good + " Nameless.", "own"), (4, good.replace("text", "prose"), "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").withColumn("n_chars", F.lit(0).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, df.limit(0), sf)
        out = stage(spark, df, sf)
        assert empty.count() == 0 and empty.columns == out.columns, name
        if name != "bpe":
            assert out.columns == df.columns, name
            assert {r["n_lines"] for r in out.collect()} <= {"own", None}, name
    assert corpus_pipeline.near_dedup_stage(spark, df, sf).count() < df.count()
