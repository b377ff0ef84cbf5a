"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash of their id and ranked; a
row's fractional rank is (rank - u) / n for the n rows of its source, ``u`` being
a seeded number between 0 and 1 of the source, so that sources of one row do not
all come to the middle.  Sorted by fractional rank, every stretch of the order
holds each source in proportion; equal cuts of it are the shards.

The law is ``rows``: the shards' counts are at most one apart.  With K sources of N
rows together, a source of n rows has n / S rows in each of S shards, give or take
1 + 2n(K + 1) / N at most.

Both orders are dealt by range and numbered by partition, over a few numbers a
row, so a source with a third of all rows is spread over many tasks and texts are
not moved.  ``write_shards`` moves each text twice: to its place, then to its file.

Defined results: a null text has size 16 and the CRC of no bytes; a null source is
a source of its own; a null id is shuffled as the word null; rows of one id are
ordered by size and CRC, wholly equal rows share their places in any order; very
long texts count by their size only in ``size``; fewer rows than shards leave
shards empty; an empty table gives no rows.  Equal texts are not kept together.
Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered

LAW = "rows"
#: Bytes a row counts besides its text.
OVERHEAD = 16


def _seeded(seed: int, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null"))).cast("binary"))


def fractional(rank: Column, n: Column, source: Column, seed: int) -> Column:
    """(rank - u) / n with u = (h + 1/2) / 2**32, h being 32 bits of the source's hash."""
    h = F.conv(F.substring(_seeded(seed, source), 1, 8), 16, 10).cast("double")
    return (rank.cast("double") - (h + 0.5) / 4294967296.0) / n.cast("double")


def _features(docs: DataFrame, columns: list[Column], source: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length(data).cast("bigint") + OVERHEAD
    return docs.select(*columns, F.col(source).cast("string").alias("source"), size.alias("size"), F.crc32(data).alias("text_crc32"))


def _place(own: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``own`` (doc_id, source, size, text_crc32 and more) with shard and slot."""
    shuffled = own.withColumn("_hash", _seeded(seed, F.col("doc_id")))
    order = ["source", "_hash", "doc_id", "size", "text_crc32"]
    spread = F.monotonically_increasing_id()  # deals out wholly equal rows
    rows = numbered(shuffled.withColumn("_spread", spread), [*order, "_spread"], "shuffled", "_at")
    # a source lies in a run of partitions: a key is a part of one partition
    parts = rows.groupBy("source", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("start"))
    whole = parts.groupBy("source").agg(F.sum("n").alias("_n"), F.min("start").alias("_start"))
    p, w = parts.alias("p"), whole.alias("w")
    parts = p.join(w, F.col("p.source").eqNullSafe(F.col("w.source"))).select("p.source", "p._part", "w._n", "w._start")
    r, k = rows.alias("r"), parts.alias("k")
    on = F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r._part") == F.col("k._part"))
    rank = F.col("r._at") - F.col("k._start") + 1
    ranked = r.join(k, on).select(
        *(f"r.{c}" for c in own.columns), rank.alias("_rank"), fractional(rank, F.col("k._n"), F.col("r.source"), seed).alias("_fraction")
    )
    placed = numbered(ranked, ["_fraction", "source", "_rank"], "interleaved", "_at")
    total = placed.count()
    # in whole numbers; a shard starts at the first place p with p * shards >= shard * total
    shard = F.expr(f"_at * {n_shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("_shard", shard).select(
        *own.columns, F.col("_shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot")
    )


def assign(docs: DataFrame, n_shards: int, seed: int = 0, source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot), a row for a row of ``docs``.

    ``size`` is the UTF-8 bytes of the text and 16 more; shards count from 0, and so
    do slots within a shard.
    """
    if n_shards < 1:
        raise ValueError("there must be a shard")
    return _place(_features(docs, [F.col("doc_id")], source, text), n_shards, seed)


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 0, source: str = "source", text: str = "text") -> DataFrame:
    """Writes the whole rows as Parquet below ``path``, a folder ``shard=k`` for each
    shard and its rows in the order of ``slot``; returns that table.

    Rows are told apart by a number written with them, so ids may repeat.
    """
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("columns called shard and slot would clash with those of the shards")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("_row"))
    kept = materialise(named, "rows")  # a row keeps its number
    flat = kept.select("_row", F.col("row.doc_id").alias("doc_id"), F.col(f"row.`{source}`").alias("_source"), F.col(f"row.`{text}`").alias("_text"))
    places = _place(_features(flat, [F.col("doc_id"), F.col("_row")], "_source", "_text"), n_shards, seed).select("_row", "shard", "slot")
    whole = kept.join(places, "_row").select("row.*", "shard", "slot")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.repartitionByRange(max(n, n_shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(whole.schema).parquet(path).select(whole.columns)
