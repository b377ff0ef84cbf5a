"""Near-duplicate documents by SimHash and bit-sliced comparison.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
3-word shingles.  Two documents are linked when their fingerprints differ in at
most ``RADIUS`` bits; a component is what links connect.

1. Exact copies of a fingerprint collapse to one row (partial aggregation).
2. Pigeonhole: of ``blocks`` blocks of bits, ``blocks - RADIUS`` are equal in a
   linked pair, so each choice of that many blocks is one bucket key.  This is
   exact whatever the number of blocks.
3. A bucket above ``TILE`` fingerprints is split into tiles, each compared with
   each, so that a hot bucket is many tasks and nothing is capped.
4. Within a tile the bit planes are stored vertically: one machine word holds
   one bit of 64 fingerprints, and carry-save counters update 64 distances at
   once.  A block whose 64 distances all exceed the radius is abandoned.
   A tile returns a spanning forest of its links, never all pairs.
5. The forests are joined to components by alternating large-star and small-star
   rounds, written to the shared folder after each.

Defined results: a null text is an empty one; texts without words have
fingerprint zero and link like any other; repeated rows each get a row; a null
id never names a component unless all its members lack an id; a very long text is
hashed whole, its bits counted by strips; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 2048
SMALL = 64
STRIP = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as a signed integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STRIP):  # 64 bytes a shingle: strips bound them for long texts
        bits = np.unpackbits(np.array(hashes[k : k + STRIP], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, fp[, th]) of every row; ``th`` is a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["id", "fp", "th"][: 2 + digest])

    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), *([F.xxhash64(text).alias("th")] if digest else []))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fp bigint" + ", th bigint" * digest).withColumnRenamed("id", id_col)


def transpose_bits(words: np.ndarray) -> np.ndarray:
    """(64, n / 64) planes of n 64-bit numbers; n is a multiple of 64.

    Bit j of ``planes[b, k]`` is bit b of ``words[64 k + j]``.
    """
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(64, -1, 8).copy().view("<u8")[:, :, 0]


def close(plane: Callable[[int, np.ndarray], np.ndarray], n_blocks: int, radius: int) -> np.ndarray:
    """For each block of 64 comparisons the bits whose distance is in ``radius``.

    ``plane(b, blocks)`` gives bit b of the differences of these blocks.  The
    counters start so that they overflow at ``radius + 1``.
    """
    size = (radius + 1).bit_length()
    start = (1 << size) - radius - 1
    out = np.zeros(n_blocks, np.uint64)
    at = np.arange(n_blocks)
    counters = [np.full(n_blocks, ALL if start >> i & 1 else 0, np.uint64) for i in range(size)]
    over = np.zeros(n_blocks, np.uint64)
    for b in range(64):
        carry = plane(b, at)
        for i in range(size):
            c = counters[i]
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if b % 8 == 7:
            alive = over != ALL
            if not alive.all():
                at, over = at[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(at):
                    return out
    out[at] = ~over
    return out


def _pairs_of_small(lists: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within each of many small lists, compared all together."""
    left, right = [], []
    for n, same in itertools.groupby(sorted(lists, key=len), key=len):
        i, j = np.triu_indices(n, 1)
        block = np.stack(list(same))
        left.append(block[:, i].ravel())
        right.append(block[:, j].ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    found_a, found_b = [], []
    for k in range(0, len(a), 1 << 18):
        x, y = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
        pad = -len(x) % 64
        planes = transpose_bits(np.concatenate([x ^ y, np.full(pad, ALL)]))
        hit = np.unpackbits(close(lambda bit, at: planes[bit, at], planes.shape[1], radius).view(np.uint8), bitorder="little")  # noqa: B023
        hit = np.flatnonzero(hit[: len(x)])
        found_a.append(x[hit])
        found_b.append(y[hit])
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(values: np.ndarray, radius: int, n_queries: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for those of a tile that hang on another one."""
    n = len(values)
    order = np.sort(values)
    planes = transpose_bits(np.concatenate([order, np.zeros(-n % 64, np.uint64)]))
    width = planes.shape[1]
    root = np.arange(n)
    for q in range(0, n, n_queries):
        ask = order[q : q + n_queries]
        first = q // 64  # earlier blocks were compared when they asked
        span = width - first
        mask = np.where(ask[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1), ALL, np.uint64(0))
        hits = close(lambda bit, at: planes[bit, first + at % span] ^ mask[bit, at // span], len(ask) * span, radius)  # noqa: B023
        hits = hits.reshape(len(ask), span)
        for k in np.flatnonzero((hits != 0).any(axis=1)):
            mine = np.flatnonzero(np.unpackbits(hits[k].view(np.uint8), bitorder="little")[: n - first * 64]) + first * 64
            roots = root[mine]
            least = min(int(roots.min()), int(root[q + k]))
            if int(roots.max()) != least or int(root[q + k]) != least:
                root[np.isin(root, np.append(roots, root[q + k]))] = least
    linked = root != np.arange(n)
    return order[linked], order[root[linked]]


def _links_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = b.column(0)
        flat = values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
        lists = np.split(flat, ends[:-1]) if len(ends) else []
        small = [x for x in lists if 2 <= len(x) <= SMALL]
        found = [_pairs_of_small(small, RADIUS)] if small else []
        found += [forest(x, RADIUS) for x in lists if len(x) > SMALL]
        if found:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _blocks_for(n: int) -> int:
    """How many blocks keep the mean bucket small; any number is exact."""
    return 4 if n <= 1 << 24 else 5 if n <= 1 << 33 else 6


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(u, v): linked fingerprints, enough of them to connect all that link."""
    blocks = _blocks_for(n)
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = lambda i: F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    keys = [
        F.struct(F.lit(k).alias("k"), F.xxhash64(*(block(i) for i in chosen)).alias("h"))
        for k, chosen in enumerate(itertools.combinations(range(blocks), blocks - RADIUS))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.h")
    hot = rows.groupBy("k", "h").agg(F.count("*").alias("c")).filter(F.col("c") > TILE)
    parts = F.ceil(F.col("c") * 2 / TILE).cast("int")
    # at most n / TILE buckets a key are hot
    dealt = rows.join(hot.select("k", "h", parts.alias("m")), ["k", "h"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    tiles = F.when(F.col("m").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("m") - 1),
            lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")),
        )
    )
    listed = (
        dealt.select("k", "h", "fp", F.explode(tiles).alias("t"))
        .groupBy("k", "h", "t")
        .agg(F.collect_list("fp").alias("fps"))  # about TILE at most
        .filter(F.size("fps") > 1)
    )
    return listed.select("fps").mapInArrow(_links_of_tiles, "u bigint, v bigint")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the least node.

    Alternating star contraction: the number of rounds grows with the logarithm
    of the longest chain.
    """

    def round_of(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        return small.select("x.u", F.col("x.m").alias("v")).filter("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = mark(e)
    for _ in range(max_rounds):
        e = materialise(round_of(e), "stars")
        now = mark(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp, th) of every document and (fp, root) of every fingerprint; ``th``
    is the text's digest."""
    fps = materialise(fingerprints(docs, id_col, text_col, digest=True), "fingerprints")
    distinct = materialise(fps.select("fp").distinct(), "distinct")
    roots = components(links(distinct, distinct.count()))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return fps, materialise(named.select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every document."""
    fps, roots = _classes(docs, id_col, text_col)
    # one row a fingerprint before the join, so that a group of copies is one row of it
    least = fps.groupBy("fp").agg(F.min(id_col).alias("rep")).join(roots, "fp")
    ids = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialise(roots.join(ids, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the least id and,
    where an id repeats with different texts, the least digest of these.

    Rows that repeat id and text are one document.  Rows without an id cannot name
    a component and all stay.
    """
    named = docs.filter(F.col(f"`{id_col}`").isNotNull())
    fps, roots = _classes(named, id_col, text_col)
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col(id_col).alias("id"), "th")).alias("x")).join(roots, "fp")
    keep = materialise(first.groupBy("root").agg(F.min("x").alias("x")).select("x.id", "x.th"), "kept")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = named.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    kept = own.join(keep, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    out = kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return out.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
