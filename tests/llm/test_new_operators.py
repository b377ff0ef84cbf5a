"""Alignment, the conversation trie and sharding against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import alignment, sharding, trie

CLASH = ["row", "piece", "n", "pairs", "shard", "slot", "at", "size", "_part", "path", "bit", "pos", "_hash"]


def clashing(df):
    return df.withColumns({c: F.create_map(F.lit("k"), F.lit(c)) for c in CLASH if c not in df.columns})


# alignment -------------------------------------------------------------------

WORDS = ["the", "Thé", "don't", "x" * 90, "naïve", "漢字", "😀", "<s>", "<|endoftext|>", "a  b", "tab\tbed", "two\n\nlines", "12345", "▁", "\r\n", "\x1c y", "end "]


def texts(n=60):
    r = random.Random(2)
    out = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 12)))) for i in range(n)]
    plain = " ".join(r.choice(["alpha", "beta", "gammadelta", "it's", "naïve", "漢字漢字"]) for _ in range(3000))
    return out + [(n, None), (n, ""), (n + 1, " "), (n + 2, "lead"), (n + 2, "lead"), (None, "nobody"), (n + 3, plain), (n + 4, "漢" * 900)]


def spelled_groups(text, sides):
    a, b = sides
    if not text:
        return [], [], []
    ids = (a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text))
    if any(b"".join(s.spelled[i] for i in x) != (" " + text).encode() for s, x in zip(sides, ids, strict=True)):
        return [], [], []
    ends = [np.cumsum([len(s.spelled[i]) for i in x]).tolist() for s, x in zip(sides, ids, strict=True)]
    groups, last = [], -1
    for e in sorted(set(ends[0]) & set(ends[1])):
        groups.append([[i for i, z in zip(x, where, strict=True) if last < z <= e] for x, where in zip(ids, ends, strict=True)])
        last = e
    return *ids, groups


@pytest.mark.parametrize(("work", "most"), [(1 << 16, 1 << 18), (40, 50)])
def test_alignment_matches_brute_force(spark, work, most):
    rows = texts()
    sides = alignment.vocabularies(alignment.default_paths()).both
    found = [spelled_groups(t, sides) for _, t in rows]
    held = Counter(p for _, _, groups in found for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for (i, _), (a, b, groups) in zip(rows, found, strict=True):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        want.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    done, links = alignment.align(df, work=work)
    scores = alignment.score_links(links, alignment.pair_counts(links), most)
    got = done.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)), F.coalesce("count_sum", F.lit(0)), "groups_sha256")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 40


def test_cuts_are_equal_work_and_keep_ends_together():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(1, 5000, n)) for n in (900, 2500))
    b = np.union1d(b, a[::7])
    cuts = alignment.diagonal_cuts(a, b, 100)
    assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b))
    for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False):
        assert 0 < k - i + m - j <= 101
        if k < len(a) and m:
            assert a[k] > b[m - 1]
        if m < len(b) and k:
            assert b[m] > a[k - 1]


def test_alignment_of_no_rows(spark):
    done, links = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert done.count() == 0 and alignment.score_links(links, alignment.pair_counts(links)).count() == 0


def test_large_groups_are_linked_through_distinct_tokens():
    p = alignment.Piece(np.repeat([5, 6], 50), np.repeat([1, 2, 1], 40), np.arange(1, 101) * 12, np.arange(1, 121) * 10)
    p.a_group[:], p.b_group[:], p.n = 0, 0, 1
    keys, times = p.pairs()
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == {x * alignment.WIDTH + y: 50 * n for x in (5, 6) for y, n in ((1, 80), (2, 40))}


# the trie --------------------------------------------------------------------


def brute_trie(convs):
    """{prefix: figures} of {conv_id: turns}."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = {}
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(p))
        out[p] = (own[0], len(p), members[p[:-1]][0] if p else None, len(own), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(repr, out.values()))


def conversations():
    r = random.Random(5)
    rows = []
    for c in range(140):
        for t in range(r.randint(0, 5)):
            rows.append((c, t, r.choice(["user", None]), r.choice(["hi", "yes", "", None, "naïve 😀"])))
    rows += [(500, t, "user", f"turn {t}") for t in range(200)] + [(501, t, "user", f"turn {t % 100}") for t in range(150)]
    rows += [(7, 1, "user", "again"), (7, 1, "user", "again"), (7, None, "user", "first"), (None, 0, "user", "lost"), (-150, 1, "user", "hi")]
    return rows


def ordered(rows):
    def key(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append((t is not None, t or 0, key(role, text), role, text))
    return {c: tuple(x[3:] for x in sorted(ts)) for c, ts in out.items()}


FIGURES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(params=[(2048, 100_000), (8, 2)])
def sizes(request, monkeypatch):
    for name, value in zip(("SHARD", "HEAVY"), request.param, strict=True):
        monkeypatch.setattr(trie, name, value)
    monkeypatch.setattr(trie, "BLOCK", 50)
    return request.param




def test_trie_matches_brute_force(spark, sizes):
    df = clashing(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string"))
    got = trie.conversation_trie(df).select(FIGURES).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_trie(ordered(conversations()))


def test_trie_with_heads_of_other_conversations(spark):
    own = ordered(conversations())
    head = lambda c: zlib.crc32(str(c).encode()) % 6
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    built = {c: own.get(base(c), ())[: head(c)] + ts[head(c) :] for c, ts in own.items()}
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    c = F.col("conv_id")
    rows, convs = trie.with_heads(trie.turns(df), c - c % 100, F.crc32(c.cast("string")) % 6, 5, c % 100 == 0)
    got = trie.prefix_trie(rows, convs).select(FIGURES).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_trie(built)


def test_strips_walk_like_one(monkeypatch):
    r = random.Random(8)
    rows = sorted((p, c, bytes([r.randrange(3)]) * 16) for c in range(40) for p in range(1, r.randint(1, 30)))
    results = []
    for strip in (2, 64):
        monkeypatch.setattr(trie, "STRIP", strip)
        walk, nodes = trie._Walk(0, list(range(40))), []
        for p, c, key in rows:
            while p > walk.upto:
                nodes += walk.advance(False)
            walk.strip.add(p, c, key, 1)
        results.append(sorted(map(repr, nodes + list(walk.advance(True)))))
    assert results[0] == results[1]


def test_trie_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(df).count() == 0


# sharding --------------------------------------------------------------------


def documents():
    r = random.Random(4)
    rows = [(i, r.choice(["hot"] * 5 + ["a", "b", None, f"rare{i}"]), "é" * r.randint(0, 9)) for i in range(900)]
    return rows + [(None, "a", "x"), (5, "a", None), (5, "a", "y"), (5, "a", "y"), (6, None, None)]


def test_shards_follow_the_mixture(spark):
    rows = documents()
    df = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    for n in (1, 7, 40):
        got = sharding.assign(df, n).collect()
        assert Counter((r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in got) == Counter((i, s, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, s, t in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert set(slots) == set(range(n)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        sources, per = Counter(s for _, s, _ in rows), Counter((r["source"], r["shard"]) for r in got)
        k, total = len(sources), len(rows)
        for s in ("hot", "a", "b", None):
            for shard in range(n):
                assert abs(per[s, shard] - sources[s] / n) <= 1 + 2 * sources[s] * (k + 1) / total
                assert abs(per[s, shard] - sources[s] / n) <= 5  # sources' errors cancel
        key = lambda found: Counter(map(tuple, found))
        assert key(sharding.assign(df.repartition(3, "doc_id"), n).collect()) == key(got)
    assert key(sharding.assign(df, 7, seed=1).collect()) != key(sharding.assign(df, 7).collect())
    assert sharding.assign(df.limit(0), 4).count() == 0
    few = sharding.assign(df.limit(2), 5).collect()
    assert len({r["shard"] for r in few}) == 2 and all(r["slot"] == 0 for r in few)
    with pytest.raises(ValueError):
        sharding.assign(df, 0)


def test_written_shards_hold_the_rows_in_order(spark, tmp_path):
    df = spark.createDataFrame(documents(), "doc_id long, source string, text string").withColumn("row", F.lit(1))
    path = f"file://{tmp_path}/shards"
    out = sharding.write_shards(df, path, 6)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert Counter(map(tuple, out.select(df.columns).collect())) == Counter(map(tuple, df.collect()))
    places = lambda x: Counter((r["doc_id"], r["shard"], r["slot"]) for r in x.collect())
    assert places(out) == places(sharding.assign(df, 6))
    for f in (tmp_path / "shards").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(f"file://{f}").collect()]
        assert slots == sorted(slots)
    with pytest.raises(ValueError):
        sharding.write_shards(out, path + "2", 2)
