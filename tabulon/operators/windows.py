"""Group statistics beside the rows, ranks, codes, row-wise functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile7
from .rows import lagged, number_rows, running_total


def number(df: DataFrame, order_by, by: list[str] = (), n: str = "_n", size: str = "_n_all") -> DataFrame:
    """The row number and the size of the group, or of the whole table.  Names ignore
    case, so that ``_N`` cannot stand beside ``_n``."""
    return number_rows(df, order_by, n, by, size)


def egen(df: DataFrame, new: str, fn: str, col: str, by: list[str] = (), where: Column | None = None) -> DataFrame:
    """mean, median, sum, total, count, min, max, sd of a group beside each row.

    Groups are aggregated before they are joined back, so that a group with a
    third of all rows is added up in parts; without ``by`` it is one number.
    """
    v = F.col(col) if where is None else F.when(where, F.col(col))
    if fn == "median":  # the groups of the result are those of all rows
        q = quantile7(df.withColumn("_v", v), ["_v"], [0.5], list(by)).select(*by, F.col("q").alias(new))
        return _joined(df, q, list(by))
    agg = {
        "mean": F.avg(v),
        "sum": F.coalesce(F.sum(v), F.lit(0)),
        "total": F.coalesce(F.sum(v), F.lit(0)),
        "count": F.count(v),
        "min": F.min(v),
        "max": F.max(v),
        "sd": F.stddev_samp(v),
    }[fn]
    return _joined(df, df.groupBy(*by).agg(agg.alias(new)), list(by))


def _joined(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return df.join(F.broadcast(groups))  # one row
    keys = groups.select(*(F.col(b).alias(f"_g_{b}") for b in by), *(c for c in groups.columns if c not in by))
    on = [df[b].eqNullSafe(keys[f"_g_{b}"]) for b in by]
    return df.join(keys, on, "left").drop(*(f"_g_{b}" for b in by))


def standardise(df: DataFrame, new: str, col: str, by: list[str] = ()) -> DataFrame:
    groups = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    return _joined(df, groups, list(by)).withColumn(new, F.try_divide(F.col(col) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def rank(df: DataFrame, new: str, col: str, by: list[str] = ()) -> DataFrame:
    """Mean ranks of ties; missing for missing.  Distinct values are counted and
    ranked before they are joined back, over all rows by range."""
    by = list(by)
    ties = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_k"))
    ties = running_total(ties, [col], F.col("_k"), "_cum", by)
    return _joined(df, ties.select(*by, col, (F.col("_cum") - (F.col("_k") - 1) / 2).alias(new)), [*by, col])


def group_id(df: DataFrame, new: str, *cols: str) -> DataFrame:
    """1…G in the order of the keys; rows with a missing key get none."""
    keys = number_rows(df.select(*cols).dropna().distinct(), list(cols), new)
    return _joined(df, keys, list(cols))


def tag(df: DataFrame, new: str, keys: list[str], order_by) -> DataFrame:
    """1 for the first row of each group, else 0."""
    return number_rows(df, order_by, "_tag_n", keys).withColumn(new, (F.col("_tag_n") == 1).cast("int")).drop("_tag_n")


def seq(df: DataFrame, new: str, order_by, by: list[str] = ()) -> DataFrame:
    return number_rows(df, order_by, new, by)


def rowwise(df: DataFrame, new: str, fn: str, *cols: str) -> DataFrame:
    """rowtotal, rowsum, rowmean, rowmin, rowmax, rowmiss, rownonmiss."""
    v = [F.col(c).cast("double") for c in cols]
    total = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0.0)) for x in v))
    there = reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in v))
    out = {
        "rowtotal": total,
        "rowsum": total,
        "rowmean": F.try_divide(total, there.cast("double")),
        "rowmin": F.least(*v) if len(v) > 1 else v[0],
        "rowmax": F.greatest(*v) if len(v) > 1 else v[0],
        "rowmiss": len(v) - there,
        "rownonmiss": there,
    }[fn]
    return df.withColumn(new, out)


def concat(df: DataFrame, new: str, *cols: str, na: str = "nan") -> DataFrame:
    return df.withColumn(new, F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit(na)) for c in cols)))


def difference(df: DataFrame, new: str, col: str, panel: str, time: str, lag: int = 1) -> DataFrame:
    """The change of ``col`` since ``lag`` rows before in the panel."""
    out = lagged(df, {"_lagged": col}, [panel], [time], lag)
    return out.withColumn(new, F.col(col) - F.col("_lagged")).drop("_lagged")
