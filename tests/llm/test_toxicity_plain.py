"""The label model and the classifier of the toxicity operator, against plain versions
that go row by row over all documents."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from tabulon.llm import toxicity
from tabulon.llm.toxicity import LABEL_WEIGHT, LabelModel

VOTERS = 4


def _documents(seed: int) -> list[tuple[tuple[int, ...], int]]:
    """(votes, kind) with kind 0: no label, 1: clean, 2: toxic; voters 0 and 1 agree often."""
    r = random.Random(seed)
    out = []
    for _ in range(300):
        toxic = r.random() < 0.3
        first = int(r.random() < (0.7 if toxic else 0.05))
        votes = (first, first if r.random() < 0.8 else 1 - first, *(int(r.random() < (0.6 if toxic else 0.1)) for _ in range(VOTERS - 2)))
        out.append((votes, 0))
        if r.random() < 0.3:  # a labelled row is counted beside its unlabelled self
            out.append((votes, 2 if toxic else 1))
    return out


def _patterns(documents) -> dict[int, tuple[int, int, int]]:
    out: dict[int, list[int]] = {}
    for votes, kind in documents:
        out.setdefault(sum(v << k for k, v in enumerate(votes)), [0, 0, 0])[kind] += 1
    return {k: tuple(v) for k, v in out.items()}


def _start(votes) -> list[float]:
    fired = sum(votes)
    return [0.98, 0.019, 0.001] if fired == 0 else [0.1, 0.8, 0.1] if fired < 3 else [0.1, 0.1, 0.8]


def _weights(documents, share) -> list[list[float]]:
    out = []
    for votes, kind in documents:
        p = share[votes]
        rest = p[1] + p[2]
        out.append([*p] if kind == 0 else [LABEL_WEIGHT, 0, 0] if kind == 1 else [0, LABEL_WEIGHT * p[1] / rest, LABEL_WEIGHT * p[2] / rest])
    return out


def _em(documents, share, parent, rounds):
    """Expectation-maximisation with a table P(vote | class, parent's vote) a voter."""
    for _ in range(rounds):
        weights = _weights(documents, share)
        total = [sum(w[c] for w in weights) for c in range(3)]
        new = {}
        yes = {}
        for j, c, g in itertools.product(range(VOTERS), range(3), (0, 1)):
            own = [(w[c], d[0][j]) for w, d in zip(weights, documents, strict=True) if (d[0][parent[j]] if parent[j] >= 0 else 0) == g]
            yes[j, c, g] = (sum(w * v for w, v in own) + 0.01) / (sum(w for w, _ in own) + 0.02)
        for votes in share:
            p = []
            for c in range(3):
                x = total[c] / sum(total) + 1e-12
                for j in range(VOTERS):
                    q = yes[j, c, votes[parent[j]] if parent[j] >= 0 else 0]
                    x *= q if votes[j] else 1 - q
                p.append(x)
            top = max(p)
            p = [x / top + 1e-12 for x in p]
            new[votes] = [x / sum(p) for x in p]
        share = new
    return share


def _information(documents, share) -> dict[tuple[int, int], float]:
    """Mutual information of two votes within a class, classes by their weight."""
    weights, out = _weights(documents, share), {}
    whole = sum(map(sum, weights))
    for i, j in itertools.combinations(range(VOTERS), 2):
        out[i, j] = 0.0
        for c in range(3):
            size = sum(w[c] for w in weights)
            joint = {(a, b): sum(w[c] for w, d in zip(weights, documents, strict=True) if (d[0][i], d[0][j]) == (a, b)) / size + 1e-12 for a in (0, 1) for b in (0, 1)}
            gain = sum(p * math.log(p / (joint[a, 0] + joint[a, 1]) / (joint[0, b] + joint[1, b])) for (a, b), p in joint.items())
            out[i, j] += size / whole * gain
    return out


def _spanning_trees():
    edges = list(itertools.combinations(range(VOTERS), 2))
    for chosen in itertools.combinations(edges, VOTERS - 1):
        seen = {0}
        for _ in range(VOTERS):
            seen |= {x for e in chosen if seen & set(e) for x in e}
        if len(seen) == VOTERS:
            yield chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_label_model_equals_a_row_by_row_one(seed):
    documents = _documents(seed)
    rounds = 12
    model = LabelModel(_patterns(documents), VOTERS, rounds)
    share = _em(documents, {v: _start(v) for v, _ in documents}, [-1] * VOTERS, rounds)
    information = _information(documents, share)
    best = max(sum(information[e] for e in tree) for tree in _spanning_trees())
    taken = [information[min(j, p), max(j, p)] for j, p in enumerate(model.parent) if p >= 0]
    assert math.isclose(sum(taken), best, rel_tol=1e-6, abs_tol=VOTERS * 1e-4)
    assert model.parent[1] == 0  # the two that were made to agree
    share = _em(documents, share, model.parent, rounds)
    for votes, p in share.items():
        assert math.isclose(model.posterior[sum(v << k for k, v in enumerate(votes))], 1 - p[0], rel_tol=1e-6, abs_tol=1e-9)


def test_votes_and_feature_counts_are_those_of_all_texts(spark):
    r = random.Random(4)
    texts = [None, "", *(" ".join(r.choice(["grubble", "snarkish", "calm", "LOUD", "stop!!!", "why?!", "tree"]) for _ in range(r.randint(1, 30))) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sample = spark.createDataFrame([(t, i % 3 == 0) for i, t in enumerate(texts)], "text string, toxic boolean").selectExpr("text", "cast(toxic AS int) AS toxic")
    voters = toxicity.deal(["grubble", "snarkish"])
    want: dict[int, list[int]] = {}
    train = {x[0] for x in docs.filter(toxicity.training_rows(docs["doc_id"])).select("doc_id").collect()}
    for i, t in enumerate(texts):
        own = want.setdefault(voters.vote(t), [0, 0, 0])
        own[0] += i in train
        own[2 if i % 3 == 0 else 1] += 1
    assert toxicity.vote_patterns(docs, sample, voters) == {k: tuple(v) for k, v in want.items()}
    counts: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        for f in {f for w in toxicity.words_of(t) for f in toxicity.features_of(w)}:
            counts.setdefault(f, [0, 0])[i % 3 != 0] += 1
    assert {x["feature"]: [x["toxic"], x["clean"]] for x in toxicity.feature_counts(sample).collect()} == counts


def test_classifier_equals_dense_steps_and_nears_the_optimum(spark):
    r = random.Random(8)
    words = ["grubble", "snarkish", "calmly", "meadow"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(60)]
    sample = spark.createDataFrame([(t, 0) for t in texts], "text string, toxic int").coalesce(1)
    voters = toxicity.deal(words[:2])
    posterior = {voters.vote(t): r.random() for t in sorted(set(texts))}
    vocabulary = sorted({f for t in texts for w in toxicity.words_of(t) for f in toxicity.features_of(w)})
    x = np.array([[sum(f == v for w in toxicity.words_of(t) for f in toxicity.features_of(w)) for v in vocabulary] for t in texts], float)
    y = np.array([posterior[voters.vote(t)] for t in texts])
    w, b, seen, seen_b = np.zeros(len(vocabulary)), -2.0, np.full(len(vocabulary), 1e-6), 1e-6
    for _ in range(40):
        e = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(y)
        g = x.T @ e + 1e-5 * w
        seen, seen_b = seen + g * g, seen_b + e.sum() ** 2
        w, b = w - 0.3 * g / np.sqrt(seen), b - 0.3 * e.sum() / math.sqrt(seen_b)
    got, bias = toxicity.train(sample, vocabulary, voters, posterior, 40)
    assert np.allclose(got, w, rtol=1e-6, atol=1e-9) and math.isclose(bias, b, rel_tol=1e-6)

    def loss(w, b):
        m = x @ w + b
        return float(np.mean(np.logaddexp(0, m) - y * m) + 5e-6 * w @ w)

    z = np.column_stack([x, np.ones(len(y))])
    decay = np.diag([1e-5] * len(vocabulary) + [0])
    theta = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-z @ theta))
        theta -= np.linalg.pinv((z * (p * (1 - p))[:, None]).T @ z / len(y) + decay) @ (z.T @ (p - y) / len(y) + decay @ theta)
    full, bias = toxicity.train(sample, vocabulary, voters, posterior)
    least = loss(theta[:-1], theta[-1])
    assert least <= loss(full, bias) < least * 1.01
