"""Rows: sorting, slicing, sampling, numbering, appending, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stable


def _ordered(keys) -> list[Column]:
    """Ascending keys; ``-key`` descends; missing last both ways."""
    name = lambda k: F.col(f"`{k}`")
    return [F.desc_nulls_last(name(k[1:])) if k.startswith("-") else F.asc_nulls_last(name(k)) for k in ([keys] if isinstance(keys, str) else keys)]


def sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*_ordered(keys))


def head(df: DataFrame, n: int, order_by=None) -> DataFrame:
    return (sort(df, *order_by) if order_by else df).limit(n)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with the columns of ``b`` that it lacks, null keys meeting null keys."""
    named = b.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in b.columns if c not in keys))
    on = [a[f"`{k}`"].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)]
    return a.join(named, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def dealt(df: DataFrame, keys) -> DataFrame:
    """``df`` dealt by range of ``keys``, sorted and written once; ``_part`` is a row's
    partition and ``_place`` its place there, from 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = _ordered(keys)
    # the partition stands above 33 bits of the place
    parts = stable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return parts.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def _segments(parts: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, _part, _shift, _all): the sum of ``value`` in a segment before each of its
    partitions, and in the whole segment.  A segment is a run of partitions, so this
    table has a row a segment and a row a partition at most, and no window of it has
    more rows than there are partitions."""
    sums = parts.groupBy(*_named(by), "_part").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*_named(by))
    before = F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*_named(by), "_part", F.coalesce(before, F.lit(0)).alias("_shift"), F.sum("_s").over(w).alias("_all"))


def running_total(df: DataFrame, order_by, value: Column, new: str, by: list[str] = (), total: str | None = None) -> DataFrame:
    """The sum of ``value`` over all rows of a segment up to each, without a task that
    holds a segment; ``total`` names the sum of the segment.

    Rows are dealt by range of the segment's key and ``order_by`` and written once.
    A window adds up within each part of a segment; the sums of the parts before,
    a number a part, become its offset.
    """
    by, keys = list(by), [order_by] if isinstance(order_by, str) else list(order_by)
    parts = dealt(df.withColumn("_value", value), [*by, *keys])
    own = F.sum("_value").over(Window.partitionBy(*_named(by), "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    if by:
        out = _null_safe(parts.withColumn("_own", own), _segments(parts, by, F.col("_value")), [*by, "_part"])
    else:
        sums = sorted((r["_part"], r["s"]) for r in parts.groupBy("_part").agg(F.sum("_value").alias("s")).collect())
        zero = 0.0 if any(isinstance(s, float) for _, s in sums) else 0
        offsets, upto = [], zero
        for part, s in sums:
            offsets.append((part, upto))
            upto += s or zero
        kind = dict(parts.groupBy().agg(F.sum("_value").alias("s")).dtypes)["s"]
        shifts = df.sparkSession.createDataFrame(offsets, f"_part int, _shift {kind}").withColumn("_all", F.lit(upto).cast(kind))
        out = parts.withColumn("_own", own).join(F.broadcast(shifts), "_part", "left")  # a row a partition
    out = out.withColumn(new, F.col("_own") + F.coalesce("_shift", F.lit(0)))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_part", "_place", "_value", "_own", "_shift", "_all")


def number_rows(df: DataFrame, order_by, new: str = "_n", by: list[str] = (), size: str | None = None) -> DataFrame:
    """A row number from 1 over all rows or in each segment; ``size`` names the rows of
    the segment.  Places within partitions need no window."""
    by, keys = list(by), [order_by] if isinstance(order_by, str) else list(order_by)
    parts = dealt(df, [*by, *keys])
    if by:
        # where the segment begins in each of its partitions
        sums = parts.groupBy(*_named(by), "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_s"))
        w = Window.partitionBy(*_named(by))
        before = F.coalesce(F.sum("_s").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shifts = sums.select(*_named(by), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_s").over(w).alias("_all"))
        out = _null_safe(parts, shifts, [*by, "_part"])
    else:
        sums = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
        offsets, upto = [], 0
        for part, s in sums:
            offsets.append((part, upto))
            upto += s
        shifts = df.sparkSession.createDataFrame(offsets, "_part int, _shift bigint").withColumn("_all", F.lit(upto).cast("bigint"))
        out = parts.join(F.broadcast(shifts), "_part")  # a row a partition
    out = out.withColumn(new, F.col("_place") + F.col("_shift") + 1)
    if size:
        out = out.withColumn(size, F.col("_all"))
    return out.drop("_part", "_place", "_shift", "_all")


def lagged(df: DataFrame, cols: dict[str, str], by: list[str], order_by, lag: int = 1) -> DataFrame:
    """``df`` with new columns that hold what each column was ``lag`` rows before in
    the segment: new name -> column.

    Rows are numbered in their segments and meet the row ``lag`` numbers before by
    segment and number, a key of one row, so a long segment is many tasks.
    """
    by = list(by)
    rows = stable(number_rows(df, order_by, "_row_of_segment", by))
    before = rows.select(*_named(by), (F.col("_row_of_segment") + lag).alias("_row_of_segment"), *(F.col(f"`{c}`").alias(new) for new, c in cols.items()))
    return _null_safe(rows, before, [*by, "_row_of_segment"], "left").drop("_row_of_segment")


def in_range(df: DataFrame, order_by, first: int, last: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows first…last, from 1 and inclusive, of those that meet ``where``."""
    df = df if where is None else df.filter(where)
    if last is not None:
        top = df.orderBy(*_ordered(order_by)).limit(last)
        if first == 1:
            return top
        df = top
    numbered = number_rows(df, order_by, "_n")
    return numbered.filter(F.col("_n").between(first, last if last is not None else (1 << 62))).drop("_n")


def sample_percent(df: DataFrame, percent: float, seed: int = 1, exact: bool = True) -> DataFrame:
    """So many percent of the rows, exactly, or each row by chance (cheap)."""
    if not exact:
        return df.sample(percent / 100, seed)
    return sample_rows(df, round(df.count() * percent / 100), seed)


#: Copies that one generated row stands for at a time, and hashes of repeated rows that are broadcast.
COPIES, MAX_REPEATED = 1 << 16, 100_000


def _content(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    own = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*own) if own else F.lit(0).cast("bigint")


def _draw(seed: int, content: Column, copy: Column) -> Column:
    """A number drawn by each copy of a row."""
    return F.xxhash64(F.lit(seed), content, F.lit("copy"), copy)


def sample_rows(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows without replacement, each row with the same chance and independently
    of rows equal to it; the same rows whatever the partitioning.

    The k copies of a row are told apart by their number, and each draws a keyed
    hash of its own; the ``n`` least win.  Only counts of equal rows and draws are
    shuffled: the n-th least draw is looked for among those near where n of N uniform
    draws must end, and rows that occur once are kept by their draw where they are
    read.  Repeated rows are reduced to one before they are written as often as they
    won.
    """
    if n <= 0:
        return df.limit(0)
    content = _content(df)
    counts = stable(df.groupBy(content.alias("h")).agg(F.count("*").alias("k")))
    total = counts.agg(F.sum("k")).first()[0] or 0
    if n >= total:
        return df
    blocks = counts.select("h", "k", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / COPIES))).alias("b"))
    upto = F.least(F.col("k"), (F.col("b") + 1) * COPIES)
    copies = blocks.select("h", "k", F.explode(F.sequence(F.col("b") * COPIES + 1, upto)).alias("j"))
    draws = copies.withColumn("u", _draw(seed, F.col("h"), F.col("j")))
    cut = _least(draws, n, total)
    won = draws.filter(F.col("u") <= cut).filter("k > 1").groupBy("h").agg(F.count("*").alias("_won"))
    repeated = counts.filter("k > 1").select(F.col("h").alias("_h")).join(won.withColumnRenamed("h", "_h"), "_h", "left")
    repeated = stable(repeated)
    few = repeated.count() <= MAX_REPEATED
    table = F.broadcast(repeated) if few else repeated
    rows = df.withColumn("_h", content)
    single = rows.join(table, "_h", "left_anti").filter(_draw(seed, F.col("_h"), F.lit(1).cast("bigint")) <= cut).drop("_h")
    one = rows.join(F.broadcast(repeated.filter("_won > 0")) if few else repeated.filter("_won > 0"), "_h").dropDuplicates(["_h"])
    again = one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_won")))).drop("_h", "_won", "_copy")
    return single.unionByName(again)


def _least(draws: DataFrame, n: int, total: int) -> int:
    """The n-th least of ``total`` uniform draws ``u``, of which two are equal by
    chance only (2**-64 a pair)."""
    width = 12 * max(n, 25) ** 0.5
    while True:
        at = lambda k: max(min(round(k / total * 2**64) - 2**63, 2**63 - 1), -(2**63))
        low, high = at(n - width), at(n + width)
        near = draws.filter((F.col("u") > low) & (F.col("u") <= high)).select("u")
        below, inside = draws.agg(F.count_if(F.col("u") <= low), F.count_if((F.col("u") > low) & (F.col("u") <= high))).first()
        if below < n <= below + inside:
            break
        if low == -(2**63) and high == 2**63 - 1:  # the least draw of all
            low = None
            near, below = draws.select("u"), 0
            break
        width *= 8
    return number_rows(near, ["u"], "_n").filter(F.col("_n") == n - below).first()["u"]


def append(a: DataFrame, b: DataFrame, flag: str | None = None, force: bool = False) -> DataFrame:
    """Rows by column name, missing columns filled; ``flag`` is 0 for ``a``, 1
    for ``b``; ``force`` turns columns of unlike types into strings."""
    if force:
        kinds = dict(b.dtypes)
        clash = [c for c, k in a.dtypes if c in kinds and kinds[c] != k]
        a, b = (x.withColumns({c: F.col(c).cast("string") for c in clash}) if clash else x for x in (a, b))
    if flag:
        a, b = a.withColumn(flag, F.lit(0)), b.withColumn(flag, F.lit(1))
    return a.unionByName(b, allowMissingColumns=True)


def _named(keys) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys]


def duplicates_report(df: DataFrame, *keys: str) -> DataFrame:
    """(copies, groups, observations, surplus)."""
    per = df.groupBy(*_named(keys or df.columns)).agg(F.count("*").alias("copies"))
    n = per.groupBy("copies").agg(F.count("*").alias("n_groups"))
    return n.select("copies", "n_groups", (F.col("copies") * F.col("n_groups")).alias("observations"), ((F.col("copies") - 1) * F.col("n_groups")).alias("surplus"))


def duplicates_drop(df: DataFrame, keys: list[str], order_by) -> DataFrame:
    """The first row of each key by ``order_by``; Spark keeps one row a key in each
    task before the shuffle."""
    w = Window.partitionBy(*_named(keys)).orderBy(*_ordered(order_by))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def duplicates_tag(df: DataFrame, keys: list[str], new: str) -> DataFrame:
    """Copies less one, counted a key before they are joined back."""
    n = df.groupBy(*_named(keys)).agg((F.count("*") - 1).alias(new))
    return _null_safe(df, n, list(keys), "left")


def duplicates_list(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicates_tag(df, keys, "_c").filter("_c > 0").drop("_c")
