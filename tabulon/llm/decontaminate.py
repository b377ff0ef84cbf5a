"""Benchmark decontamination with a broadcast set of normalised n-grams.

The windows (``n`` consecutive words) of the benchmark items are a hash set of
proven size, which every task gets with the plan; above ``max_windows`` windows a
shuffled join finds the candidates instead.  A scan of a document

1. looks up every ``step``-th short anchor of words; a document without any
   anchor cannot hold a window and is done;
2. looks up every window; the set compares words, so that a hit is one, and the
   join compares hashes and then verifies the words.

With the set all of this happens inside the document's row: nothing is shuffled
and hot passages or sources cannot gather in one task.

Defined results: a null text has no words; a null or wordless item has no
window; an item shorter than ``n`` words is one window; items with equal windows
are all reported; repeated rows give repeated results; an empty benchmark hits
nothing; extra columns are ignored by ``find_contamination`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialise

#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_AND_REST = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
MAX_WINDOWS = 50_000
SALTS = 8


def normal_words(text: Column) -> Column:
    pieces = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
    return F.transform(pieces, ascii_lower)


def _gram(words: Column, at: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def _starts(words: Column, n: int, step: int = 1) -> Column:
    """1, 1 + step, … as far as ``n`` words follow; empty when there are fewer."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n_words, gram): the windows of each item, once an item."""
    words = items.select(F.col(id_col).cast("string").alias("item"), normal_words(F.col(text_col)).alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return (
        words.filter((F.size("w") > 0) & F.col("item").isNotNull())
        .select("item", size.alias("n_words"), F.explode(F.transform(starts, lambda i: _gram(F.col("w"), i, size))).alias("gram"))
        .distinct()
    )


def _scan(words: Column, grams: dict[str, int]) -> Column:
    """Verified hits of the set ``grams`` in ``words``: array of (at, n)."""
    lengths = sorted(set(grams.values()))
    none = F.array().cast("array<struct<at:int,n:int>>")
    if not lengths:
        return none
    k = (lengths[0] + 1) // 2
    step = lengths[0] - k + 1
    anchors = sorted({" ".join(g.split(" ")[i : i + k]) for g in grams for i in range(len(g.split(" ")) - k + 1)})

    def hits(n: int) -> Column:
        own = sorted(g for g, m in grams.items() if m == n)
        found = F.filter(_starts(words, n), lambda i: _gram(words, i, n).isin(own))
        return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n")))

    near = F.exists(_starts(words, k, step), lambda i: _gram(words, i, k).isin(anchors))
    return F.when(near, F.concat(*(hits(n) for n in lengths))).otherwise(none)


def _covered(hits: Column) -> Column:
    """The word positions, from 1, that lie in a hit."""
    spans = F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))
    return F.array_distinct(spans)


def _found_by_set(rows: DataFrame, text: Column, windows: list) -> Column:
    """struct(n_words, covered, items) of a text, from the set in the plan."""
    grams = {r["gram"]: r["n_words"] for r in windows}
    items: dict[str, list[str]] = {}
    for r in windows:
        items.setdefault(r["item"], []).append(r["gram"])
    table = json.dumps([{"item": i, "grams": sorted(g)} for i, g in sorted(items.items())])
    of_items = F.from_json(F.lit(table), "array<struct<item:string,grams:array<string>>>")

    def result(w: Column) -> Column:
        return let(
            _scan(w, grams),
            lambda hits: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                _covered(hits).alias("covered"),
                F.when(F.size(hits) == 0, F.array().cast("array<string>"))
                .otherwise(
                    let(
                        F.array_distinct(F.transform(hits, lambda h: _gram(w, h["at"], h["n"]))),
                        lambda g: F.array_sort(
                            F.transform(F.filter(of_items, lambda x: F.arrays_overlap(x["grams"], g)), lambda x: x["item"])
                        ),
                    )
                )
                .alias("items"),
            ),
        )

    return let(normal_words(text), result)


def _meeting(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` (_id, h, …) joined with the smaller ``right`` (h, …): each copy of
    ``right`` meets a part of the documents, so that a passage in a third of them is
    ``SALTS`` keys."""
    dealt = left.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["h", "_s"], how).drop("_s")


def _found_by_join(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """As ``_found_by_set`` for a benchmark too large to stand in the plan.

    ``rows`` has (_row, _text) and is written once with a number for each row.
    Every ``step``-th anchor of a document is looked up by a join; only documents
    with one send the hashes of their windows, which are verified by their words
    when they come back to the document.
    """
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()), "rows")
    lengths = sorted(r[0] for r in windows.select("n_words").distinct().collect())  # at most n numbers
    k = (lengths[0] + 1) // 2
    step = lengths[0] - k + 1
    w = rows.select("_id", normal_words(F.col("_text")).alias("w"))
    hashes = lambda words, n, step: F.transform(_starts(words, n, step), lambda i: F.xxhash64(_gram(words, i, n)))
    anchors = windows.select(F.explode(hashes(F.split("gram", " "), k, 1)).alias("h")).distinct()
    asked = w.select("_id", F.explode(F.array_distinct(hashes(F.col("w"), k, step))).alias("h"))
    near = materialise(_meeting(asked, anchors, "left_semi").select("_id").distinct(), "candidates")

    def hashed(n: int) -> Column:
        return F.transform(
            _starts(F.col("w"), n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(_gram(F.col("w"), i, n)).alias("h"))
        )

    each = w.join(near, "_id", "left_semi").select("_id", F.explode(F.concat(*(hashed(n) for n in lengths))).alias("x"))
    grams = windows.select(F.xxhash64("gram").alias("h"), "gram").distinct()
    met = _meeting(each.select("_id", "x.at", "x.n", "x.h"), grams)
    hits = met.groupBy("_id").agg(F.collect_set(F.struct("at", "n", "gram")).alias("c"))
    same = lambda w: F.filter("c", lambda h: _gram(w, h["at"], h["n"]) == h["gram"])
    verified = rows.select("_id", "_text").join(hits, "_id").select("_id", let(normal_words(F.col("_text")), same).alias("hits"))
    verified = materialise(verified, "hits")
    named = verified.select("_id", F.explode(F.array_distinct(F.transform("hits", lambda h: h["gram"]))).alias("gram"))
    items = _meeting(named.withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "own"), windows.select(F.xxhash64("gram").alias("h"), "gram", "item"))
    items = items.filter("own = gram").groupBy("_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = rows.join(verified, "_id", "left").join(items, "_id", "left")
    found = F.struct(
        F.size(normal_words(F.col("_text"))).cast("bigint").alias("n_words"),
        F.coalesce(_covered(F.col("hits")), F.array().cast("array<int>")).alias("covered"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return joined.select("_row", "_text", found.alias("_f"))


def _with_found(docs: DataFrame, items: DataFrame, n: int, text_col: str, max_windows: int) -> DataFrame:
    """(_row, _text, _f) with the row of ``docs`` as a struct beside its findings."""
    own = [c for c, kind in docs.dtypes if kind != "void"]  # columns without a type cannot be written
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    windows = benchmark_windows(items, n)
    few = windows.limit(max_windows + 1).collect()  # bounded by the limit
    if len(few) > max_windows:
        return _found_by_join(rows, windows)
    return rows.select("_row", "_text", _found_by_set(rows, F.col("_text"), few).alias("_f"))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) of every document."""
    only = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return _with_found(only, items, n, "text", max_windows).select(
        F.col("_row.id").alias(id_col),
        F.col("_f.n_words").alias("n_words"),
        F.size("_f.covered").cast("bigint").alias("n_hit"),
        F.col("_f.items").alias("items"),
        (F.size("_f.covered") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    mode: str = "document",
    n: int = 10,
    text_col: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``docs`` without what the benchmark holds.

    ``mode="document"`` drops every document with a hit; ``mode="span"`` cuts
    the hit words, with the separators after each, out of the text.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode is document or span, not {mode}")
    found = _with_found(docs, items, n, text_col, max_windows)
    void = {c for c, kind in docs.dtypes if kind == "void"}
    names = docs.columns
    of = lambda c: F.lit(None) if c in void else F.col(f"_row.`{c}`")
    if mode == "document":
        return found.filter(F.size("_f.covered") == 0).select(*(of(c).alias(c) for c in names))
    cut = let(
        F.regexp_extract_all("_text", F.lit(WORD_AND_REST), 0),
        lambda pieces: F.concat(
            F.regexp_extract("_text", "^" + SEPARATORS, 0),
            F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(1), F.size(pieces)), F.col("_f.covered")),
                    lambda i: F.get(pieces, i - 1),
                ),
                "",
            ),
        ),
    )
    text = F.when(F.size("_f.covered") == 0, F.col("_text")).otherwise(cut)
    return found.select(*((text if c == text_col else of(c)).alias(c) for c in names))
