"""Line deduplication with a distributed suffix array over line ids.

Every line becomes an id (a 128-bit digest), a document a sequence of ids.  Only
stretches of lines that each occur more than once, and that hold ``min_words``
words together, can hold a repeated run worth deleting; the rest is left out.

1. Prefix doubling: in round k the suffixes are ranked by their first 2**k lines,
   as the ranks of pairs of ranks from the round before.  A round sorts the
   *distinct* pairs by range, so a line that fills a third of the corpus is one
   row of the sort.  The last ranks are the suffix array; suffixes with one rank
   are one entry of it.
2. Longest common prefixes: an entry and the one before it share at least 2**k
   lines where their ranks of round k are equal, and the exact number is read
   from the ranks of round k at the later places.  It is needed only between the
   least number of lines that hold ``min_words`` words and the least after which
   the next suffix takes over.
3. Intervals: for a depth d the entries between two places where the common
   prefix is shorter than d are an interval; its suffixes share a run of d lines.
   A running sum of these places over (depth, entry) numbers all intervals.
4. The earliest suffix of an interval is the first copy.  A suffix loses the
   lines of its deepest interval that holds an earlier one: its maximal repeated
   run, as far as the suffixes after it do not cover the rest.

The first copy, by id, then by the text's digest, then by line, stays.

Defined results: a null text stays null; an empty text is one empty line; rows
that repeat id and text are one document for the order of copies and each lose
the same lines; a null id comes first; runs that overlap themselves keep their
first copy; a very long text is one stretch of lines at most, held as one array
of numbers; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rows import running_total
from .common import BLANKS, let, materialise

MIN_WORDS = 50


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, line, h1, h2, words): a row a line."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    each = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(
            F.xxhash64(x).alias("h1"),
            F.xxhash64(F.lit(1), x, F.lit(2)).alias("h2"),
            F.size(F.array_remove(F.split(x, BLANKS), "")).alias("words"),
        ),
    )
    return own.select("id", F.xxhash64("text").alias("th"), F.posexplode(each).alias("line", "x")).select("id", "th", "line", "x.*")


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, th, line, h1, h2, words, seg): repeated lines in stretches of
    ``min_words`` words or more; ``seg`` is the stretch's first line."""
    twice = materialise(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "repeated")
    own = materialise(lines.join(twice, ["h1", "h2"], "left_semi").dropDuplicates(["id", "th", "line"]), "candidates")
    doc = Window.partitionBy("id", "th").orderBy("line")
    run = own.withColumn("run", F.col("line") - F.row_number().over(doc))
    whole = Window.partitionBy("id", "th", "run")
    seg = run.withColumns({"total": F.sum("words").over(whole), "seg": F.min("line").over(whole)})
    seg = seg.filter(F.col("total") >= min_words)
    return seg.select("id", "th", "seg", "line", "h1", "h2", F.col("words").cast("bigint").alias("words"))


def _at_least(c: Column, low: Column, target: Column) -> Column:
    """The least index from ``low`` at which the rising array ``c`` reaches
    ``target``; its size if there is none.  A binary search."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        near = F.when(F.get(c, mid) >= target, F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(
            F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        )
        return F.when(s["lo"] >= s["hi"], s).otherwise(near)

    start = F.struct(low.cast("int").alias("lo"), F.size(c).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), start, step)["lo"]


def _depths(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, th, seg, line, lo, hi): the depths at which a suffix is looked at.

    ``lo`` is the least number of lines with ``min_words`` words; ``hi`` the last
    at which the suffix after it is still too short.  Both follow from the lines
    themselves, so suffixes that share ``hi`` lines are looked at alike.
    """
    before = Window.partitionBy("id", "th", "seg").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("id", "th", "seg", "line", F.sum("words").over(before).alias("c"))
    held = summed.groupBy("id", "th", "seg").agg(F.sort_array(F.collect_list(F.struct("line", "c"))).alias("x"))
    # c[i] is the number of words before line i
    held = held.select("id", "th", "seg", F.concat(F.array(F.lit(0).cast("bigint")), F.transform("x", lambda x: x["c"])).alias("c"))
    c, n = F.col("c"), F.size("c") - 1
    index = F.sequence(F.lit(0), n - 1)
    least = held.withColumn("m", F.transform(index, lambda i: _at_least(c, i + 1, F.get(c, i) + min_words) - i))
    fits = F.filter(index, lambda i: F.get(F.col("m"), i) + i <= n)
    after = lambda i: F.when((i + 1 < n) & (F.get(F.col("m"), i + 1) + i + 1 <= n), F.get(F.col("m"), i + 1)).otherwise(n - i)
    each = F.transform(fits, lambda i: F.struct(i.alias("i"), F.get(F.col("m"), i).alias("lo"), F.greatest(F.get(F.col("m"), i), after(i)).alias("hi")))
    return least.select("id", "th", "seg", F.explode(each).alias("w")).select("id", "th", "seg", (F.col("seg") + F.col("w.i")).alias("line"), "w.lo", "w.hi")


def _ranked(rows: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, rank): ranks in the order of the distinct pairs.

    The pairs are dealt by range and sorted within the partitions, so that an id
    that rises along partitions and rows is a rank; gaps do not matter.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.select(*pair).distinct()
    ordered = distinct.repartitionByRange(parts, *pair).sortWithinPartitions(*pair)
    return materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _joined_rank(rows: DataFrame, ranks: DataFrame, pair: list[str], name: str) -> DataFrame:
    return rows.join(ranks.withColumnRenamed("rank", name), pair)


def suffix_ranks(rows: DataFrame, levels: int) -> DataFrame:
    """(id, th, seg, line, r0 … r<levels>): the rank of the suffix at each line by
    its first 2**k lines, the end of a stretch being less than any line."""
    ranks = _ranked(rows, ["h1", "h2"])
    state = materialise(_joined_rank(rows, ranks, ["h1", "h2"], "r0").select("id", "th", "seg", "line", "r0"), "suffixes")
    order = Window.partitionBy("id", "th", "seg").orderBy("line")
    for k in range(levels):
        own = [c for c in state.columns if c != "later"]
        later = F.coalesce(F.lead(f"r{k}", 1 << k).over(order), F.lit(-1))
        paired = materialise(state.select(*own, later.alias("later")), "pairs")
        ranks = _ranked(paired, [f"r{k}", "later"])
        state = materialise(_joined_rank(paired, ranks, [f"r{k}", "later"], f"r{k + 1}").drop("later"), "suffixes")
    return state


def _suffix_array(suffixes: DataFrame, depths: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The suffixes with depths, and (rank, first, lo, hi, r, before): an entry a distinct suffix, ``first`` being
    its earliest place and ``before`` (r, first) of the entry before it."""
    on = suffixes["id"].eqNullSafe(depths["id"]) & (suffixes["th"] == depths["th"]) & (suffixes["line"] == depths["line"])
    r = F.array(*(F.col(f"r{k}") for k in range(levels)))
    own = suffixes.join(depths, on).select(F.col(f"r{levels}").alias("rank"), suffixes["id"], suffixes["th"], suffixes["line"], suffixes["seg"], "lo", "hi", r.alias("r"))
    held = materialise(own, "held")
    one = held.groupBy("rank").agg(F.min(F.struct("id", "th", "line", "seg", "lo", "hi", "r")).alias("x"))
    place = F.struct("x.id", "x.th", "x.line", "x.seg")
    # ranks are numbered along the partitions of the sort that made them
    entries = materialise(one.select("rank", F.shiftright("rank", 33).alias("part"), place.alias("first"), "x.lo", "x.hi", "x.r"), "entries")
    here = Window.partitionBy("part").orderBy("rank")
    ends = entries.groupBy("part").agg(F.max_by(F.struct("r", "first"), "rank").alias("e"))
    ends = ends.select("part", F.lag("e").over(Window.orderBy("part")).alias("e"))  # a row a partition
    pairs = entries.withColumn("b", F.lag(F.struct("r", "first")).over(here)).join(F.broadcast(ends), "part")
    return held, pairs.select("rank", "first", "lo", "hi", "r", F.coalesce("b", "e").alias("before"))


def _common_prefixes(array: DataFrame, suffixes: DataFrame, levels: int) -> DataFrame:
    """(rank, first, lo, hi, lcp): lines shared with the entry before, as far as
    they matter: ``lo`` - 1 at least and ``hi`` at most."""
    r = lambda k: F.get("r", F.lit(k)) == F.get("before.r", F.lit(k))
    same = [r(k) for k in range(levels)]
    k = F.lit(-1)
    for j, x in enumerate(same):
        k = F.when(F.coalesce(x, F.lit(False)), F.lit(j)).otherwise(k)
    power = F.when(F.col("k") < 0, F.lit(0)).otherwise(F.pow(F.lit(2), F.col("k")).cast("int"))
    own = array.withColumn("k", k).withColumn("least", power)
    # ranks of round k differ beyond twice 2**k lines, so the number lies between
    low = F.greatest(F.col("lo") - 1, F.col("least"))
    high = F.least(F.col("hi"), F.col("least") * 2 - 1)
    own = materialise(own.withColumns({"low": F.least(low, F.col("hi")), "high": high}), "neighbours")
    asked = own.filter("k >= 0 AND high > low").select("rank", "k", "least", F.col("first").alias("y"), F.col("before.first").alias("x"), F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("d"))
    table = suffixes.select(F.col("id").alias("_i"), F.col("th").alias("_t"), F.col("seg").alias("_s"), F.col("line").alias("_l"), F.array(*(F.col(f"r{j}") for j in range(levels))).alias("_r"))

    def looked_up(q: DataFrame, at: str) -> DataFrame:
        line = F.col(f"{at}.line") + F.col("d") - F.col("least")
        on = F.col(f"{at}.id").eqNullSafe(F.col("_i")) & (F.col(f"{at}.th") == F.col("_t")) & (F.col(f"{at}.seg") == F.col("_s")) & (line == F.col("_l"))
        return q.join(table, on).withColumn(f"r_{at}", F.get("_r", F.col("k"))).drop("_i", "_t", "_s", "_l", "_r")

    met = looked_up(looked_up(asked, "x"), "y").filter("r_x = r_y").groupBy("rank").agg(F.max("d").alias("d"))
    return own.join(met, "rank", "left").select("rank", "first", "lo", "hi", F.coalesce("d", F.when(F.col("k") >= 0, F.col("low")).otherwise(F.col("lo") - 1)).alias("lcp"))


def _intervals(entries: DataFrame) -> DataFrame:
    """(rank, copies): for each entry its depths with the earliest place of the
    interval at this depth, where that is of use."""
    at = entries.select("rank", "first", F.col("lcp"), F.explode(F.sequence("lo", "hi")).alias("d"))
    cut = F.when(F.col("lcp") < F.col("d"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    numbered = running_total(at.select("rank", "first", "d", cut.alias("cut")), ["d", "rank"], F.col("cut"), "interval")
    numbered = materialise(numbered, "intervals")
    least = numbered.groupBy("interval").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    # entries alone in their interval are their own first copy
    own = numbered.select("interval", "rank", "d").join(materialise(least, "least"), "interval")
    return own.groupBy("rank").agg(F.collect_list(F.struct("d", "least")).alias("copies"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): line spans (first, last) of later copies; ``th`` is the
    text's digest.  Documents without any are not listed."""
    lines = materialise(_lines(docs, id_col, text_col), "lines")
    rows = materialise(_stretches(lines, min_words), "stretches")
    depths = materialise(_depths(rows, min_words), "depths")
    longest = depths.agg(F.max("hi")).first()[0] or 1
    levels = longest.bit_length()  # 2**levels lines tell apart all that matters
    suffixes = suffix_ranks(rows, levels)
    held, array = _suffix_array(suffixes, depths, levels)
    copies = materialise(_intervals(_common_prefixes(array, suffixes, levels)), "copies")
    place = F.struct("id", "th", "line", "seg")
    met = held.select("rank", place.alias("place"), "id", "th", "line").join(copies, "rank")
    later = F.filter("copies", lambda x: x["least"] < F.col("place"))
    depth = F.array_max(F.transform(later, lambda x: x["d"]))
    spans = met.withColumn("d", depth).filter("d IS NOT NULL").select("id", "th", F.col("line").alias("first"), (F.col("line") + F.col("d") - 1).alias("last"))
    return spans.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def _kept(lines: Column, spans: Column) -> Column:
    """The lines outside all spans; spans are sorted."""
    gone = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(at, lambda i: F.get(lines, i))


def drop_repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = False, counts: bool = True
) -> DataFrame:
    """``docs`` without the lines of later copies and, with ``counts``, ``n_lines``
    and ``n_lines_dropped``, which replace columns of these names; ``drop_empty``
    leaves out documents that lost all lines."""
    found = materialise(repeated_lines(docs, min_words, id_col, text_col).toDF("id", "th", "spans"), "spans")
    # both sides grow with the corpus: never a broadcast, at no size
    found = found.hint("merge")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("own_th"))
    joined = own.join(found, own["doc"].eqNullSafe(found["id"]) & (own["own_th"] == found["th"]), "left").select("row", "spans")
    text = F.col(f"row.`{text_col}`")
    result = F.when(
        F.col("spans").isNotNull(),
        let(
            F.split(text, "\n"),
            lambda x: let(
                _kept(x, F.col("spans")),
                lambda y: F.struct(F.array_join(y, "\n").alias("text"), F.size(x).alias("n"), F.size(y).alias("left")),
            ),
        ),
    ).otherwise(F.struct(text.alias("text"), F.size(F.split(text, "\n")).alias("n"), F.size(F.split(text, "\n")).alias("left")))
    out = joined.withColumn("result", result)
    if drop_empty:
        out = out.filter(F.col("spans").isNull() | (F.col("result.left") > 0))
    new = ("n_lines", "n_lines_dropped") if counts else ()
    kept = [(F.col("result.text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in new]
    if not counts:
        return out.select(*kept)
    return out.select(
        *kept,
        F.when(text.isNull(), 0).otherwise(F.col("result.n")).cast("bigint").alias(new[0]),
        F.when(text.isNull(), 0).otherwise(F.col("result.n") - F.col("result.left")).cast("bigint").alias(new[1]),
    )
