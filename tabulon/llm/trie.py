"""A prefix trie of conversations from vertical bitmaps.

Conversations are numbered by id and cut into shards of ``SHARD``.  In a shard
each (position, turn) has a posting: the bitset of the conversations that have
this turn there.  A node of the trie is the bitset of its members; the postings of
the next position intersected with it are its children, the popcounts their
sizes, and members without a turn there are its end list.  The walk is depth-first
within strips of ``STRIP`` positions and holds the postings of one strip, so a
conversation of any length is walked in bounded memory.  Children are found from
the members left: the lowest member's posting is the next child, so a node costs
one intersection for each child it has.

A node is known across shards by a digest of the turns that lead to it.  Shards
send one row a node; sums, least ids and the end lists, in the order of the shards,
give the whole trie.  Subtree sums are taken shard by shard from the deepest
position upwards: every shard adds what its own members weigh, and what counts
once a node (a leaf, the first copy of a turn) is added by the first shard that
holds the node.

Nothing is keyed by a turn alone: a first turn that a third of all conversations
share is one row a shard.  Children of a node with more children than
``HEAVY`` or a thousandth of all nodes learn its id from a broadcast of these
nodes, at most a thousand.

Defined results: turns are ordered by turn, null first, ties by the digest of role
and text; a null role or text is empty; repeated rows are turns of their own; rows
without a conversation id belong to none and are left out; very long texts take
part by a digest and their length; an empty table gives no rows, not even a root.
Only the named columns are read.  Digests have 128 bits: at 10^12 nodes the chance
of one mistake is below 10^-14.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered

#: Conversations a shard: a bitset is 256 bytes.
SHARD = 2048
#: Positions whose postings are held at a time.
STRIP = 64
HEAVY = 100_000
ROWS_OUT = 4096
#: Positions that one joined block of a conversation spans.
BLOCK = 1 << 16
ROOT = b"\0" * 16


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, size) of all turns, positions from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    own = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", key.alias("turn_key"), F.char_length(text).cast("bigint").alias("size")
    )
    placed = numbered(own, ["conv_id", F.asc_nulls_first("turn"), "turn_key"], "turns", "at")
    # a conversation lies in a run of partitions; places count from its first row
    parts = placed.groupBy("conv_id", "_part").agg(F.min("at").alias("start"))
    first = parts.groupBy("conv_id").agg(F.min("start").alias("first"))
    starts = parts.join(first, "conv_id").select("conv_id", "_part", "first")
    out = placed.join(starts, ["conv_id", "_part"])
    return out.select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "turn_key", "size")


def with_heads(own: DataFrame, base: Column, head: Column, most: int, can_be_base: Column) -> tuple[DataFrame, DataFrame]:
    """Turns with the first ``head`` of each conversation taken from conversation
    ``base`` (both from conv_id), and (conv_id, n) of all conversations, also those
    left without a turn.  ``head`` is at most ``most``."""
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumns({"base": base, "head": head.cast("bigint")})
    start = own.filter((F.col("pos") <= most) & can_be_base).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "size"))).alias("start"))
    convs = convs.join(start, "base", "left")
    taken = F.least(F.col("head"), F.coalesce(F.size("start"), F.lit(0)).cast("bigint"))
    convs = convs.withColumn("taken", taken)
    heads = convs.filter("taken > 0").select("conv_id", F.explode(F.slice("start", 1, F.col("taken").cast("int"))).alias("x")).select("conv_id", "x.*")
    shift = convs.filter("n_own > head").select("conv_id", "head", "taken", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_own") / BLOCK))).alias("block"))
    rest = own.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(shift, ["conv_id", "block"]).filter("pos > head")
    rest = rest.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "turn_key", "size")
    counts = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))).alias("n"))
    return heads.unionByName(rest), counts


class _Strip:
    """The postings of some positions of one shard."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys: dict[int, list[bytes]] = {}
        self.sizes: dict[int, list[int]] = {}
        self.sets: dict[int, list[int]] = {}
        self.number: dict[int, dict[bytes, int]] = {}
        self.turn_of: dict[int, dict[int, int]] = {}
        self.all: dict[int, int] = {}

    def add(self, pos: int, bit: int, key: bytes, size: int) -> None:
        known = self.number.setdefault(pos, {})
        k = known.setdefault(key, len(known))
        if k == len(self.sets.setdefault(pos, [])):
            self.sets[pos].append(0)
            self.keys.setdefault(pos, []).append(key)
            self.sizes.setdefault(pos, []).append(size)
        self.sets[pos][k] |= 1 << bit
        self.turn_of.setdefault(pos, {})[bit] = k
        self.all[pos] = self.all.get(pos, 0) | 1 << bit


class _Walk:
    """The trie of one shard, strip by strip."""

    def __init__(self, shard: int, ids: list[int]) -> None:
        self.shard, self.ids = shard, ids
        self.strip = _Strip()
        self.upto = STRIP
        self.frontier = [((1 << len(ids)) - 1, 0, ROOT, None, 0)]

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out

    def advance(self, last: bool) -> Iterator[tuple]:
        """Depth-first from the frontier through the strip; a row a node."""
        strip, stack, later = self.strip, self.frontier[::-1], []
        while stack:
            node = stack.pop()
            bits, depth, path, parent, size = node
            pos = depth + 1
            if depth == self.upto and not last:
                later.append(node)
                continue
            here = bits & strip.all.get(pos, 0)
            first = self.ids[(bits & -bits).bit_length() - 1]
            ends = ",".join(map(str, self.members(bits ^ here)))
            yield self.shard, depth, path, parent, first, bits.bit_count(), size, ends, here != 0
            children = []
            while here:
                k = strip.turn_of[pos][(here & -here).bit_length() - 1]
                child = bits & strip.sets[pos][k]
                here &= ~child
                children.append((child, pos, hashlib.md5(path + strip.keys[pos][k]).digest(), path, strip.sizes[pos][k]))
            stack += children[::-1]
        self.frontier = later
        self.upto += STRIP
        strip.clear()


LOCAL = pa.schema([("shard", pa.int64()), ("depth", pa.int64()), ("path", pa.binary()), ("parent", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("ends", pa.string()), ("inner", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _walk_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, pos, bit, conv_id, turn_key, size), sorted so, the members at
    position 0; a row a node of each shard."""

    def nodes() -> Iterator[tuple]:
        walk: _Walk | None = None
        members: list[int] = []
        at = None
        for shard, pos, bit, conv_id, key, size in _columns(batches):
            if shard != at:
                if at is not None:
                    yield from (walk or _Walk(at, members)).advance(True)
                at, walk, members = shard, None, []
            if pos == 0:
                members.append(conv_id)
                continue
            if walk is None:
                walk = _Walk(shard, members)
            while pos > walk.upto:
                yield from walk.advance(False)
            walk.strip.add(pos, bit, key, size)
        if at is not None:
            yield from (walk or _Walk(at, members)).advance(True)

    yield from _in_batches(nodes(), LOCAL)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, shard, ends), sorted so: a digest a path of its lists, joined."""
    schema = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])

    def digests() -> Iterator[tuple]:
        at, sha = None, None
        for path, _, ends in _columns(batches):
            if path != at:
                if at is not None:
                    yield at, sha.hexdigest()
                at, sha = path, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ends.encode())
        if at is not None:
            yield at, sha.hexdigest()

    yield from _in_batches(digests(), schema)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, depth, path, parent, leaf, saved), deepest first in each shard: the
    same with the sums of the subtrees in the shard.  Holds one level at a time."""
    schema = pa.schema([("path", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])

    def sums() -> Iterator[tuple]:
        at: tuple = ()
        own: dict[bytes, tuple[int, int]] = {}
        above: dict[bytes, tuple[int, int]] = {}
        for shard, depth, path, parent, leaf, saved in _columns(batches):
            if (shard, depth) != at:
                own = above if at[:1] == (shard,) else {}
                at, above = (shard, depth), {}
            below = own.pop(path, (0, 0))
            leaf, saved = leaf + below[0], saved + below[1]
            yield path, leaf, saved
            if parent is not None:
                a, b = above.get(parent, (0, 0))
                above[parent] = a + leaf, b + saved

    yield from _in_batches(sums(), schema)


def local_tries(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of each shard, of turns (conv_id, pos, turn_key, size) and all
    conversations (conv_id)."""
    order = numbered(convs.select("conv_id", F.lit(0).alias("none")), ["conv_id"], "conversations", "at")
    spot = order.select("conv_id", F.floor(F.col("at") / SHARD).alias("shard"), (F.col("at") % SHARD).alias("bit"))
    spot = materialise(spot, "spots")
    spans = convs.select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / BLOCK))).alias("block")).join(spot, "conv_id")
    own = rows.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(spans, ["conv_id", "block"])
    own = own.select("shard", "pos", "bit", "conv_id", "turn_key", "size")
    members = spot.select("shard", F.lit(0).cast("bigint").alias("pos"), "bit", "conv_id", F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("bigint").alias("size"))
    dealt = own.unionByName(members).repartition("shard").sortWithinPartitions("shard", "pos", "bit")
    kinds = "shard bigint, depth bigint, path binary, parent binary, first bigint, n bigint, size bigint, ends string, inner boolean"
    return materialise(dealt.mapInArrow(_walk_shards, kinds), "tries")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(path, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), a row a node.

    ``rows`` has conv_id, pos (from 1 without gaps), turn_key and size; ``convs``
    conv_id and n, its number of turns, for all conversations.
    """
    local = local_tries(rows, convs)
    nodes = local.groupBy("path").agg(
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("size").alias("size"),
        F.min("first").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        F.min("shard").alias("owner"),
        F.max("inner").alias("inner"),
    )
    nodes = materialise(nodes, "nodes")

    k, n = local.alias("k"), nodes.alias("n")
    mine = F.col("k.shard") == F.col("n.owner")
    saved = F.col("k.n") * F.col("k.size") - F.when(mine, F.col("k.size")).otherwise(0)
    weighed = k.join(n, F.col("k.path") == F.col("n.path")).select(
        "k.shard", "k.depth", "k.path", "k.parent", (mine & ~F.col("n.inner")).cast("bigint").alias("leaf"), saved.alias("saved")
    )
    upwards = weighed.repartition("shard").sortWithinPartitions("shard", F.desc("depth"))
    sums = upwards.mapInArrow(_add_up, "path binary, leaves bigint, saved bigint").groupBy("path").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    lists = local.filter("ends <> ''").select("path", "shard", "ends").repartition("path").sortWithinPartitions("path", "shard")
    ends = lists.mapInArrow(_hash_ends, "path binary, ends_sha256 string")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(sums, "path").join(ends, "path", "left").join(children, "path", "left")
    none = hashlib.sha256().hexdigest()
    whole = materialise(
        whole.select(
            "path", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        ),
        "trie",
    )
    return _with_parents(whole)


def _with_parents(nodes: DataFrame) -> DataFrame:
    total = nodes.count()
    many = F.col("n_children") > max(HEAVY, total // 1000)
    ids = nodes.filter("n_children > 0").select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = ids.filter(many).drop("n_children")  # at most a thousand rows
    known = nodes.join(F.broadcast(heavy), "parent", "left")
    light = ids.filter(~many).select("parent", F.col("parent_conv_id").alias("_id"))
    rest = known.filter("parent_conv_id IS NULL AND parent IS NOT NULL").join(light, "parent").withColumn("parent_conv_id", F.col("_id")).drop("_id")
    out = known.filter("parent_conv_id IS NOT NULL OR parent IS NULL").unionByName(rest)
    return out.select("path", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text) as they are."""
    own = materialise(turns(rows), "turns")
    return prefix_trie(own, own.groupBy("conv_id").agg(F.count("*").alias("n")))
