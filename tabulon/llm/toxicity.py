"""Toxicity by weak supervision.

1. A bounded sample of labelled training rows (``MAX_LABELLED``, a parameter)
   gives a lexicon: words and word beginnings with high log odds of being toxic.
2. The lexicon is dealt to voters (word lists and beginning patterns, plus
   patterns of shouting); each votes or abstains on a document.
3. A generative label model explains the vote patterns of all training
   documents, counted by Spark (at most 2**voters rows).  Expectation-
   maximisation estimates the voters' accuracies in latent classes of clean, mild
   and heavy toxicity, a maximum spanning tree over conditional mutual
   information finds the correlations, and EM estimates the model again with them.
4. A linear (logistic) classifier over words and beginnings learns the posterior
   labels of the sample and scores every whole text.

Labels, language, source and id are never inputs of a score.  Defined results: a
null text is an empty one and gets the score of the bias; repeated rows get
equal scores; a null id counts as training; labels that repeat an id count as toxic if any does, null labels
are left out; without any labelled toxic row every score is 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Labelled rows that the lexicon and the classifier learn from, at most.
MAX_LABELLED = 12_000
#: Entries of the lexicon, and features of the classifier with their least document count.
MAX_LEXICON = 500
MAX_FEATURES = 20_000
LEAST_DOCS = 4
N_LIST_VOTERS = 10
#: How many documents a labelled one stands for when the label model is fitted.
LABEL_WEIGHT = 10
WORD = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 500_000


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """A word and its beginnings of four and five letters."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


def training_rows(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id") -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled training rows, drawn by hash."""
    own = labels.filter(training_rows(F.col(id_col)) & F.col("toxic").isNotNull())
    own = own.groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64(id_col), id_col).limit(limit).withColumnRenamed(id_col, "_label_id")
    joined = docs.select(id_col, "text").join(F.broadcast(own), F.col(id_col) == F.col("_label_id"))  # limit rows at most
    return materialise(joined.select("text", "toxic"), "labelled")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of each kind it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(b.column(0), b.column(1), strict=True):
                found[toxic.as_py() == 1].update({f for w in words_of(text.as_py()) for f in features_of(w)})
            for k, name in enumerate(("clean", "toxic")):
                n = pa.array(found[k].values(), pa.int64())
                zero = pa.array(np.zeros(len(n), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[k].keys(), pa.string()), n if name == "toxic" else zero, n if name == "clean" else zero],
                    names=["feature", "toxic", "clean"],
                )

    counts = sample.mapInArrow(run, "feature string, toxic bigint, clean bigint")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Voters:
    """``lists``: for each feature of the lexicon the voter that it belongs to."""

    lists: dict[str, int]
    count: int = N_LIST_VOTERS + 2

    def vote(self, text: str | None) -> int:
        """One bit a voter that votes toxic."""
        bits = 0
        for w in words_of(text):
            for f in features_of(w):
                k = self.lists.get(f)
                if k is not None:
                    bits |= 1 << k
        text = text or ""
        if re.search(r"!{3,}|\?!", text):
            bits |= 1 << N_LIST_VOTERS
        if len(re.findall(r"\b[^\W\d_a-z]{4,}\b", text)) * 10 > len(text.split()):
            bits |= 1 << N_LIST_VOTERS + 1
        return bits


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    share = lambda k, n: F.log((k + 0.5) / (n + 1))
    return share(toxic, n_toxic) - share(clean, n_clean)


def lexicon(features: list) -> list[str]:
    """Features with a log odds above 4.5, the most telling first."""
    own = [(-r["toxic"] * r["odds"], r["feature"]) for r in features if r["odds"] > 4.5]
    return [f for _, f in sorted(own)[:MAX_LEXICON]]


def deal(words: list[str]) -> Voters:
    """Entries that begin alike go to one voter, so that voters differ."""
    return Voters({f: zlib.crc32(f[:4].encode()) % N_LIST_VOTERS for f in words})


class LabelModel:
    """P(toxic | votes) from vote patterns: accuracies and correlations.

    Three latent classes, of which the first is clean and the others are mild
    and heavy toxicity; within a class a voter depends on one other voter at
    most.  ``patterns`` maps votes to (documents, labelled clean, labelled
    toxic); labels fix the class of their rows in the E step.
    """

    def __init__(self, patterns: dict[int, tuple[int, int, int]], n_voters: int, rounds: int = 100):
        keys = np.array(sorted(patterns), dtype=np.int64)
        self.votes = (keys[:, None] >> np.arange(n_voters) & 1).astype(int)
        self.weight, self.clean, self.toxic = np.array([patterns[k] for k in keys.tolist()], dtype=float).T
        self.parent = [-1] * n_voters
        fired = self.votes[:, :N_LIST_VOTERS].sum(axis=1)
        start = np.stack([np.where(fired == 0, 0.98, 0.1), np.where(fired == 0, 0.019, np.where(fired < 3, 0.8, 0.1)), np.where(fired == 0, 0.001, np.where(fired < 3, 0.1, 0.8))])
        share = self._fit(start, rounds)
        self.parent = self._tree(share)
        share = self._fit(share, rounds)
        self.posterior = dict(zip(keys.tolist(), (1 - share[0]).tolist(), strict=True))

    def _class_weights(self, share: np.ndarray) -> np.ndarray:
        own = self.weight * share
        own[0] += LABEL_WEIGHT * self.clean
        own[1:] += LABEL_WEIGHT * self.toxic * share[1:] / share[1:].sum(axis=0)
        return own

    def _given(self, j: int) -> np.ndarray:
        par = self.parent[j]
        return self.votes[:, par] if par >= 0 else np.zeros(len(self.weight), int)

    def _fit(self, share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            own = self._class_weights(share)
            logs = np.tile(np.log(own.sum(axis=1) / own.sum() + 1e-12)[:, None], (1, len(self.weight)))
            for j in range(len(self.parent)):
                given = self._given(j)
                for c, w in enumerate(own):
                    yes = (np.bincount(given, w * self.votes[:, j], 2) + 0.01) / (np.bincount(given, w, 2) + 0.02)
                    logs[c] += np.log(np.where(self.votes[:, j] == 1, yes[given], 1 - yes[given]))
            new = np.exp(logs - logs.max(axis=0)) + 1e-12
            new /= new.sum(axis=0)
            done = np.abs(new - share).max() < 1e-9
            share = new
            if done:
                break
        return share

    def _tree(self, share: np.ndarray) -> list[int]:
        """Parents from a maximum spanning tree over I(vote, vote | class)."""
        m = self.votes.shape[1]
        info = np.zeros((m, m))
        own = self._class_weights(share)
        for w in own:
            if w.sum() <= 0:
                continue
            for i in range(m):
                for j in range(i):
                    joint = np.bincount(self.votes[:, i] * 2 + self.votes[:, j], w, 4).reshape(2, 2) / w.sum() + 1e-12
                    gain = (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum()
                    info[i, j] += w.sum() / own.sum() * gain
                    info[j, i] = info[i, j]
        parent, inside = [-1] * m, {0}
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda x: info[x])
            parent[j] = i if info[i, j] > 1e-4 else -1
            inside.add(j)
        return parent


def vote_patterns(docs: DataFrame, sample: DataFrame, voters: Voters, id_col: str = "doc_id") -> dict[int, tuple[int, int, int]]:
    """Counts of the vote patterns: of all training documents, and of the sample's
    clean and toxic rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(zip((voters.vote(t.as_py()) for t in b.column(0)), b.column(1).to_pylist(), strict=True))
            votes, kinds = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(found.values(), pa.int64())], names=["votes", "kind", "n"]
            )

    all_rows = docs.filter(training_rows(F.col(id_col))).select("text", F.lit(0).alias("kind"))
    rows = all_rows.union(sample.select("text", (F.when(F.col("toxic") == 1, 2).otherwise(1)).alias("kind")))
    seen = rows.mapInArrow(run, "votes bigint, kind int, n bigint").groupBy("votes", "kind").agg(F.sum("n").alias("n"))
    out: dict[int, list[int]] = {}
    for r in seen.collect():  # 3 x 2**voters rows at most
        out.setdefault(r["votes"], [0, 0, 0])[r["kind"]] = r["n"]
    return {k: tuple(v) for k, v in out.items()}


def train(sample: DataFrame, vocabulary: list[str], voters: Voters, posterior: dict[int, float], rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights of a logistic classifier on the sample's posterior labels."""
    index = {f: i for i, f in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, target = [], []
            for t in b.column(0):
                text = t.as_py()
                found = [index[f] for w in words_of(text) for f in features_of(w) if f in index]
                rows.append(np.array(found, np.int32).tobytes())
                target.append(posterior.get(voters.vote(text), 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(target, pa.float64())], names=["x", "p"])

    got = sample.select("text").mapInArrow(run, "x binary, p double").toArrow()  # MAX_LABELLED rows at most
    rows = [np.frombuffer(x.as_py(), np.int32) for x in got.column("x")]
    y = got.column("p").to_numpy()
    size = np.array([len(r) for r in rows])
    at, doc = np.concatenate([*rows, np.zeros(0, np.int32)]), np.repeat(np.arange(len(rows)), size)
    n, bias, w = max(len(rows), 1), -2.0, np.zeros(len(vocabulary))
    seen, seen_bias = np.full(len(vocabulary), 1e-6), 1e-6
    for _ in range(rounds):  # AdaGrad over the whole sample, with a weight decay
        margin = np.clip(bias + np.bincount(doc, w[at], n), -30, 30)
        error = (1 / (1 + np.exp(-margin)) - y) / n
        slope = np.bincount(at, error[doc], len(vocabulary)) + 1e-5 * w
        seen += slope * slope
        w -= 0.3 * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.3 * error.sum() / math.sqrt(seen_bias)
    return w, float(bias)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        known: dict[str, float] = {}
        get = self.weights.get

        def score(text: str | None) -> float:
            total = self.bias
            for w in words_of(text):
                s = known.get(w)
                if s is None:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    s = known[w] = sum(get(f, 0.0) for f in features_of(w))
                total += s
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

        return score


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id") -> Model | None:
    """A model, or None where no labelled training row is toxic."""
    sample = labelled_sample(docs, labels, limit, id_col)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(1):
        return None
    counts = feature_counts(sample).filter(F.col("toxic") + F.col("clean") >= min(LEAST_DOCS, size[1]))
    odds = log_odds(F.col("toxic"), F.col("clean"), size[1], size.get(0, 0))
    telling = counts.withColumn("odds", odds).filter("odds > 1.5")
    kept = telling.orderBy(F.desc(F.col("toxic") * F.col("odds")), "feature").limit(MAX_FEATURES).collect()
    voters = deal(lexicon(kept))
    posterior = LabelModel(vote_patterns(docs, sample, voters, id_col), voters.count).posterior
    vocabulary = [r["feature"] for r in kept]
    w, bias = train(sample, vocabulary, voters, posterior)
    return Model({f: float(x) for f, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-3}, bias)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every whole text."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer() if model else lambda text: 0.0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py()) for t in b.column(1)], pa.float64())], names=["id", "score"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
