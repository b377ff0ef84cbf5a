"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontaminate, language_model, linededup, pii, quality, sharding, simhash, toxicity, trie, warc
from .common import blank_words, materialise, read

SHARDS = 40
#: A key for the query only; a production job takes its own from a secret store.
PII_KEY = "query key"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_lines(docs).select(
        "doc_id",
        "n_lines",
        "n_lines_dropped",
        F.size(blank_words(F.col("text"))).cast("bigint").alias("n_words_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(read(spark, sf_dir, "documents"), decoded=True)
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    probe = [F.struct(F.lit(-1), F.lit(i), F.lit(r), F.lit(tricky)) for i, r in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.inline(F.array(*probe))).toDF(*rows.columns)
    out = chat.format_trees(chat.threads(rows.union(extra)))
    said = F.transform(chat.parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = chat.masked_text(F.col("formatted"), F.col("loss_mask"))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(chat.parse_turns(F.col("formatted"))).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (~toxicity.training_rows(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(read(spark, sf_dir, "pages"))
    number = lambda fields: F.try_element_at(fields, F.lit("page-id")).cast("bigint")
    return captures.select(
        number(F.col("metadata.fields")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        number(F.col("original")).alias("refers_to"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(read(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.violates(quality.BASE).alias("base_failed"),
        (~quality.violates(quality.BASE) & ~quality.violates(quality.STANDARD)).alias("kept"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_and_replace(read(spark, sf_dir, "documents"), key=PII_KEY)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, links = alignment.align(read(spark, sf_dir, "documents"))
    scores = alignment.score_links(links, alignment.pair_counts(links))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return texts.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(trie.turns(read(spark, sf_dir, "conversations")), "turns")
    c = F.col("conv_id")
    rows, convs = trie.with_heads(own, c - c % 100, F.crc32(c.cast("string")) % 6, 5, c % 100 == 0)
    nodes = trie.prefix_trie(materialise(rows, "turns"), materialise(convs, "conversations"))
    return nodes.drop("path", "parent")


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontaminate, op2_line_dedup, op3_language_model, op4_bpe, op5_chat, op6_toxicity, op7_simhash, op8_warc, op9_quality, op10_pii, op11_align, op12_trie, op13_shards]
    return {f.__name__: f for f in found}
