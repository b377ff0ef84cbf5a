"""Language-model scores by deleted interpolation.

The probability of a word after another mixes three estimates,

    l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1),

with weights that depend on the bucket ``b`` of the context's frequency c(h)
(powers of two).  Expectation-maximisation learns the weights on held-out
counts: one tenth of the training documents, scored with the counts of the rest.
Final scores use the counts of all training documents.

A count table of a large corpus fits neither a driver nor a broadcast, and one
row a token is far larger than the text.  So documents are read in chunks of a
few million tokens, and the count table is a service made of two shuffles:

1. ``chunks``: words become numbers local to the chunk; one compact row each.
2. ``requests``: a chunk sends each *distinct* key once (64-bit hashes of words
   and word pairs, with its own training count) to the key's bucket.
3. ``replies``: a bucket adds up the counts and answers every chunk in order.
4. ``scores``: a chunk meets its replies and scores its documents.

A word or pair that fills a third of the corpus is one key a chunk, so no bucket
is hot.  Chunks and replies are tables in the shared folder; what is lost is read
or computed again from there.

Defined results: a null text is an empty one (one token, its end); repeated rows
are counted and scored each; a null id counts as training; with no training
token the score uses the uniform estimate alone; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CHUNK_TOKENS = 2_000_000
BUCKET_TOKENS = 1_000_000
HELD_OUT, EM_FOLD, REST = 0, 1, 2
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Resolution of the histogram of held-out estimates: cells a factor of two.
CELLS = 4
EM_ROUNDS = 200


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers cost nothing."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _pair_keys(words: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it in its document."""
    h = table[words]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(sizes) - sizes] = START
    with np.errstate(over="ignore"):
        return _mix(_mix(before) + h * np.uint64(0x9FB21C651E98DF25))


def fold_of(doc_id: object) -> int:
    if doc_id is None:
        return REST
    r = zlib.crc32(str(doc_id).encode()) % 10
    return HELD_OUT if r == 0 else EM_FOLD if r == 1 else REST


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a chunk: (chunk, fold, ids, sizes, words, table, n_tokens)."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        held: dict[int, list] = {}
        id_type = pa.int64()

        def row(fold: int) -> pa.RecordBatch:
            known, ids, sizes, tokens = held.pop(fold)
            found = np.array(tokens, np.int64)
            count = np.bincount(found, minlength=len(known))
            order = np.argsort(-count, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            table = np.array([xxh64_intdigest(w) if w is not None else int(END) for w in known], np.uint64)[order]
            values = {
                "chunk": pa.array([uuid.uuid4().hex]),
                "fold": pa.array([fold], pa.int32()),
                "ids": pa.array([ids], pa.list_(id_type)),
                "sizes": pa.array([_pack(np.array(sizes, np.uint32))], pa.binary()),
                "words": pa.array([_pack(rank[found])], pa.binary()),
                "table": pa.array([_pack(table)], pa.binary()),
                "n_tokens": pa.array([len(found)], pa.int64()),
            }
            return pa.RecordBatch.from_pydict(values)

        for b in batches:
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                fold = fold_of(doc_id)
                known, ids, sizes, tokens = held.setdefault(fold, [{None: 0}, [], [], []])
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                number = known.setdefault
                tokens.extend([number(w, len(known)) for w in words])
                tokens.append(0)
                ids.append(doc_id)
                sizes.append(len(words) + 1)
                if len(tokens) >= CHUNK_TOKENS:
                    yield row(fold)
        for fold in list(held):
            yield row(fold)

    schema = f"chunk string, fold int, ids array<{kind}>, sizes binary, words binary, table binary, n_tokens bigint"
    return source.mapInArrow(run, schema)


def _edges(buckets: int) -> np.ndarray:
    """The least key of each bucket but the first."""
    return np.array([-(-b * 2**64 // buckets) for b in range(1, buckets)], dtype=np.uint64)


def _keys_of(order: int, words: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[words] if order == 1 else _pair_keys(words, sizes, table)


def replies(chunk_rows: DataFrame, buckets: int) -> DataFrame:
    """(chunk, fold, part, em, rest): a chunk's keys' training counts, in key
    order; ``part`` orders the pieces.  A row with a null chunk holds in ``v``
    how many distinct training words its bucket has."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for b in batches:
            for r in b.to_pylist():
                sizes, words, table = _unpack(r["sizes"], np.uint32), _unpack(r["words"], np.uint32), _unpack(r["table"], np.uint64)
                for order in (1, 2):
                    keys, count = np.unique(_keys_of(order, words, sizes, table), return_counts=True)
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    parts = [(k, a, z) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                    for at in range(0, len(parts), 64):
                        some = parts[at : at + 64]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "part": pa.array([(order - 1) * buckets + k for k, _, _ in some], pa.int32()),
                                "chunk": pa.array([r["chunk"]] * len(some)),
                                "fold": pa.array([r["fold"]] * len(some), pa.int32()),
                                "keys": pa.array([_pack(np.diff(keys[a:z], prepend=np.uint64(0))) for _, a, z in some], pa.binary()),
                                "counts": pa.array([_pack(count[a:z].astype(np.uint32)) for _, a, z in some], pa.binary()),
                            }
                        )

    def answer(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        keys = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in t.column("keys")]
        fold = t.column("fold").to_numpy()
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate([_unpack(x.as_py(), np.uint32) for x in t.column("counts")]).astype(float)
        of = np.repeat(fold, [len(k) for k in keys])
        em, rest = (np.bincount(at, count * (of == f), len(found)).astype(np.uint64) for f in (EM_FOLD, REST))
        ends = np.cumsum([len(k) for k in keys])[:-1]
        own = np.split(at, ends)
        v = int(((em + rest) > 0).sum()) if part < buckets else 0
        n = len(own)
        return pa.table(
            {
                "chunk": pa.array([*t.column("chunk").to_pylist(), None], pa.string()),
                "fold": pa.array([*fold.tolist(), None], pa.int32()),
                "part": pa.array([part] * (n + 1), pa.int32()),
                "em": pa.array([*(_pack(em[x]) for x in own), None], pa.binary()),
                "rest": pa.array([*(_pack(rest[x]) for x in own), None], pa.binary()),
                "v": pa.array([None] * n + [v], pa.int64()),
            }
        )

    asked = chunk_rows.select("chunk", "fold", "sizes", "words", "table").mapInArrow(
        ask, "part int, chunk string, fold int, keys binary, counts binary"
    )
    return asked.groupBy("part").applyInArrow(answer, "chunk string, fold int, part int, em binary, rest binary, v bigint")


def _met(t: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk row, sizes, words, pairs): em and rest counts of each token's word and pair."""
    rows = t.to_pylist()
    own = next(r for r in rows if r["part"] < 0)
    parts = sorted((r for r in rows if r["part"] >= 0), key=lambda r: r["part"])
    sizes, words, table = (_unpack(own[k], d) for k, d in (("sizes", np.uint32), ("words", np.uint32), ("table", np.uint64)))
    sizes = sizes.astype(np.int64)
    em = np.concatenate([_unpack(r["em"], np.uint64) for r in parts])
    rest = np.concatenate([_unpack(r["rest"], np.uint64) for r in parts])
    at_word = np.argsort(np.argsort(table, kind="stable"), kind="stable")[words]
    _, at_pair = np.unique(_pair_keys(words, sizes, table), return_inverse=True)
    at_pair = at_pair + len(table)
    if len(em) != len(table) + (at_pair.max() + 1 - len(table)):
        raise ValueError(f"replies to chunk {own['chunk']} are not complete")
    counts = np.stack([em, rest]).astype(float)
    return own, sizes, counts[:, at_word], counts[:, at_pair]


def _contexts(word_counts: np.ndarray, sizes: np.ndarray, ends: float) -> np.ndarray:
    """How often each token's context occurs; a document's start as often as ends do."""
    before = np.empty_like(word_counts)
    before[1:] = word_counts[:-1]
    before[np.cumsum(sizes) - sizes] = ends
    return before


def _estimates(words: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, pair estimate, word estimate) of each token."""
    ends = words[np.cumsum(sizes) - 1][0]
    context = _contexts(words, sizes, ends)
    bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)
    return bucket, pairs / np.maximum(context, 1), words / max(n, 1)


@dataclass
class Model:
    weights: np.ndarray  # (bucket, 3) for pair, word, uniform
    n: int
    v: int

    def log10(self, bucket: np.ndarray, f2: np.ndarray, f1: np.ndarray) -> np.ndarray:
        w = self.weights[np.minimum(bucket, len(self.weights) - 1)]
        return np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (self.v + 1))


def learn_weights(cells: list[tuple], v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """EM over (bucket, n, pair estimate, word estimate)."""
    weights = np.tile(np.array([0.5, 0.4, 0.1]), (65, 1))
    if not cells:
        return np.tile(np.array([0.0, 0.0, 1.0]), (65, 1)) if v == 0 else weights
    bucket, n, f2, f1 = (np.array(x, float) for x in zip(*cells, strict=True))
    bucket = bucket.astype(int)
    f = np.stack([f2, f1, np.full(len(f1), 1 / (v + 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * f
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, k], len(weights)) for k in range(3)], axis=1)
        total += np.array([0.01, 0.01, 0.01])  # no weight vanishes
        new = total / total.sum(axis=1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    return weights


def _joined(chunk_rows: DataFrame, reply_rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("binary")
    own = chunk_rows.select("chunk", F.lit(-1).alias("part"), "fold", "ids", "sizes", "words", "table", none.alias("em"), none.alias("rest"))
    ids = chunk_rows.schema["ids"].dataType
    other = reply_rows.select(
        "chunk", "part", "fold", F.lit(None).cast(ids).alias("ids"), none.alias("sizes"), none.alias("words"), none.alias("table"), "em", "rest"
    )
    return own.unionByName(other)


def _held_out_cells(chunk_rows: DataFrame, reply_rows: DataFrame, n_rest: int, v: int) -> list[tuple]:
    """A histogram of the EM fold's estimates; its size does not follow the input."""

    def cells(t: pa.Table) -> pa.Table:
        _, sizes, words, pairs = _met(t)
        bucket, f2, f1 = _estimates(words[1], pairs[1], sizes, n_rest)
        grid = lambda f: np.where(f > 0, np.round(CELLS * np.log2(np.maximum(f, 1e-300))), 10_000).astype(np.int64)
        key = (bucket * 40_000 + grid(f2) + 20_000) * 40_000 + grid(f1) + 20_000
        found, at = np.unique(key, return_inverse=True)
        sums = [np.bincount(at, x) for x in (np.ones(len(at)), f2, f1)]
        return pa.table({"key": found, "n": sums[0], "f2": sums[1], "f1": sums[2]})

    some = _joined(chunk_rows.filter(F.col("fold") == EM_FOLD), reply_rows.filter(F.col("fold") == EM_FOLD))
    out = some.groupBy("chunk").applyInArrow(cells, "key bigint, n double, f2 double, f1 double")
    rows = out.groupBy("key").agg(F.sum("n").alias("n"), F.sum("f2").alias("f2"), F.sum("f1").alias("f1")).collect()
    return [(r["key"] // 40_000 // 40_000, r["n"], r["f2"] / r["n"], r["f1"] / r["n"]) for r in rows]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    chunk_rows = materialise(chunks(docs, id_col, text_col), "chunks")
    tokens = chunk_rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # a bucket gets the keys of so many tokens, however large the corpus is
    buckets = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    reply_rows = materialise(replies(chunk_rows, buckets), "replies")
    totals = {r["fold"]: r["n"] for r in chunk_rows.groupBy("fold").agg(F.sum("n_tokens").alias("n")).collect()}
    n_rest, n_train = totals.get(REST, 0), totals.get(REST, 0) + totals.get(EM_FOLD, 0)
    v = int(reply_rows.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0])
    answered = reply_rows.filter("chunk IS NOT NULL")
    weights = learn_weights(_held_out_cells(chunk_rows, answered, n_rest, v), v)
    model = Model(weights, n_train, v)
    floor = n_train + 0.1 * (v + 1)

    def score(t: pa.Table) -> pa.Table:
        own, sizes, words, pairs = _met(t)
        words, pairs = words.sum(axis=0), pairs.sum(axis=0)
        first = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, first)
        logs = model.log10(*_estimates(words, pairs, sizes, n_train))
        held = own["fold"] == HELD_OUT
        return pa.table(
            {
                "id": pa.array(own["ids"], t.schema.field("ids").type.value_type),
                "held_out": pa.array([held] * len(sizes), pa.bool_()),
                "n_tokens": sizes.astype(np.int64),
                "n_known": total((words > 0).astype(np.int64)),
                "train_tokens": np.full(len(sizes), n_train, np.int64),
                "base_score": total(np.log10((words + 0.1) / floor)),
                "score": total(logs),
            }
        )

    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _joined(chunk_rows, answered).groupBy("chunk").applyInArrow(score, schema).withColumnRenamed("id", id_col)


def perplexity(log10_score: float, n_tokens: int) -> float:
    return math.pow(10, -log10_score / max(n_tokens, 1))
