"""Summaries: moments, frequencies, collapsing, tests, profiles.

Weights: ``fweight`` counts copies, ``aweight`` and ``pweight`` are scaled to
sum to the number of rows, ``iweight`` is used as it is.  Rows with a weight that
is null or not positive are left out, and so are NaN values.  Percentiles with a
weight are those of the midpoint grid, without one they are linear; weighted
variances are taken about the means of the groups, in a second pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import distributions as D
from .quantiles import beside, quantiles
from .rows import _null_safe, running_total

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in NUMERIC]


def _value(x: Column) -> Column:
    """Numbers with NaN as missing."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def _weighted(x: Column, w: Column | None) -> tuple[Column, Column]:
    """(value, weight) of rows that count, null elsewhere."""
    if w is None:
        return x, F.when(x.isNotNull(), F.lit(1.0))
    ok = x.isNotNull() & (w > 0)
    return F.when(ok, x), F.when(ok, w.cast("double"))


def wmean(x: Column, w: Column) -> Column:
    v, k = _weighted(x, w)
    return F.try_divide(F.sum(v * k), F.sum(k))


def wvar(x: Column, w: Column, wtype: str, about: Column | float = 0.0) -> Column:
    """Variance from sums of deviations from ``about``, which should be near the mean:
    the closer it is, the less is lost.  ``weighted_moments`` gives it the mean."""
    v, k = _weighted(x, w)
    d = v - about
    s0, s1, s2, n = F.sum(k), F.sum(d * k), F.sum(d * d * k), F.count(k)
    ss = s2 - s1 * s1 / s0
    if wtype == "fweight":
        out = ss / (s0 - 1)
    elif wtype == "iweight":
        out = ss / s0
    else:
        out = ss * n / s0 / (n - 1)
    return F.when(n >= 2, F.greatest(out, F.lit(0.0)))


def weighted_moments(df: DataFrame, cols: list[str], weight: Column, wtypes: list[str], by: list[str] = ()) -> DataFrame:
    """(by, var__<wtype>__<column> …): variances about the weighted means of the groups.

    The means are aggregated first and meet the rows again, so that nothing cancels
    whatever the size of the values; both passes combine before they shuffle.
    """
    by = list(by)
    keys = [F.col(f"`{b}`") for b in by]
    own = df.select(*keys, *(_value(F.col(f"`{c}`")).alias(f"_x{i}") for i, c in enumerate(cols)), weight.cast("double").alias("_w"))
    x, w = [F.col(f"_x{i}") for i in range(len(cols))], F.col("_w")
    means = own.groupBy(*keys).agg(*(wmean(v, w).alias(f"_m{i}") for i, v in enumerate(x)))
    rows = _null_safe(own, means, by) if by else own.join(F.broadcast(means))  # one row
    each = [wvar(v, w, t, F.col(f"_m{i}")).alias(f"var__{t}__{c}") for i, (v, c) in enumerate(zip(x, cols, strict=True)) for t in wtypes]
    return rows.groupBy(*keys).agg(*each)


def effective_n(w: Column) -> Column:
    k = F.when(w > 0, w)
    return F.try_divide(F.sum(k) * F.sum(k), F.sum(k * k))


def _percentile(stat: str) -> list[float]:
    """The percentiles that a statistic needs; none for others."""
    if stat == "iqr":
        return [0.25, 0.75]
    if stat == "median":
        return [0.5]
    return [int(stat[1:]) / 100] if stat[0] == "p" and stat[1:].isdigit() else []


def statistic(stat: str, x: Column, w: Column | None = None, wtype: str = "aweight", order_by: Column | None = None) -> Column:
    """An aggregate by name, of those that one pass can give."""
    v, k = _weighted(x, w)
    if stat in ("first", "last"):
        return (F.min_by if stat == "first" else F.max_by)(x, order_by)
    if stat == "range":
        return F.max(v) - F.min(v)
    if stat in ("n", "count"):
        return F.count(v) if w is None else F.sum(k) if wtype == "fweight" else F.count(k)
    if stat in ("min", "max"):
        return getattr(F, stat)(v)
    if w is None:
        plain = {"mean": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0)), "total": F.coalesce(F.sum(v), F.lit(0)), "sd": F.stddev_samp(v), "var": F.var_samp(v)}
        return plain[stat]
    weighted = {"mean": wmean(x, w), "sum": F.coalesce(F.sum(v * k), F.lit(0.0))}
    return weighted["sum" if stat == "total" else stat]


def group_statistics(
    df: DataFrame,
    specs: dict[str, tuple[str, str]],
    by: list[str] = (),
    weight: Column | None = None,
    wtype: str = "aweight",
    order_by: Column | None = None,
) -> DataFrame:
    """(by, new columns): new name -> (statistic, column), a row a group.

    What one aggregate can give comes from one; weighted variances take a second
    pass about the means, percentiles the plans of ``quantiles``; all meet by group.
    """
    by = list(by)
    keys = [F.col(f"`{b}`") for b in by]
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def source(col: str) -> Column:
        x = F.col(f"`{col}`")
        return _value(x).cast(kinds[col]) if kinds[col] in ("float", "double") else x

    late = {n: sv for n, sv in specs.items() if _percentile(sv[0]) or (weight is not None and sv[0] in ("sd", "var"))}
    plain = [statistic(s, source(v), weight, wtype, order_by).alias(n) for n, (s, v) in specs.items() if n not in late]
    out = df.groupBy(*keys).agg(*(plain or [F.count("*").alias("_rows")]))
    spread = {n: sv for n, sv in late.items() if not _percentile(sv[0])}
    if spread:
        found = weighted_moments(df, list(dict.fromkeys(v for _, v in spread.values())), weight, [wtype], by)
        var = lambda v: F.col(f"`var__{wtype}__{v}`")
        table = found.select(*keys, *((F.sqrt(var(v)) if s == "sd" else var(v)).alias(n) for n, (s, v) in spread.items()))
        out = _null_safe(out, table, by, "left") if by else out.join(F.broadcast(table))  # one row
    ranks = {n: sv for n, sv in late.items() if _percentile(sv[0])}
    if ranks:
        ps = sorted({p for s, _ in ranks.values() for p in _percentile(s)})
        q = quantiles(df, list(dict.fromkeys(v for _, v in ranks.values())), ps, by, weight, midpoint=weight is not None)
        named = {f"_q{i}_{k}": (v, p) for i, (s, v) in enumerate(ranks.values()) for k, p in enumerate(_percentile(s))}
        out = beside(out, q, by, named)
        got = {n: F.col(f"_q{i}_1") - F.col(f"_q{i}_0") if s == "iqr" else F.col(f"_q{i}_0") for i, (n, (s, _)) in enumerate(ranks.items())}
        out = out.withColumns(got).drop(*named)
    return out.select(*keys, *(F.col(f"`{n}`") for n in specs))


def summarize(df: DataFrame, *cols: str, weight: Column | None = None, wtype: str = "aweight", by: list[str] = (), detail: bool = False) -> DataFrame:
    """(by, variable, n, mean, sd, min, max[, p1 … p99]).  NaN counts as missing."""
    cols, by = list(cols) or [c for c in numeric_columns(df) if c not in by], list(by)
    stats = ["n", "mean", "sd", "min", "max", *(f"p{p}" for p in PERCENTILES if detail)]
    return _many(df, cols, stats, by, weight, wtype, "variable")


def _many(df: DataFrame, cols: list[str], stats: list[str], by: list[str], weight: Column | None, wtype: str, rows: str) -> DataFrame:
    """Statistics of several columns: (by, variable, one column a statistic) or (by,
    stat, one column a variable)."""
    w = [] if weight is None else [weight.alias("_w")]
    keys = [F.col(f"`{b}`") for b in by]
    own = df.select(*keys, *(_value(F.col(f"`{c}`")).alias(f"_x{i}") for i, c in enumerate(cols)), *w)
    specs = {f"{s}__{i}": (s, f"_x{i}") for s in stats for i in range(len(cols))}
    wide = group_statistics(own, specs, by, F.col("_w") if w else None, wtype)
    if rows == "variable":
        each = [F.struct(F.lit(c).alias("variable"), *(F.col(f"{s}__{i}").alias(s) for s in stats)) for i, c in enumerate(cols)]
    else:
        each = [F.struct(F.lit(s).alias("stat"), *(F.col(f"{s}__{i}").cast("double").alias(c) for i, c in enumerate(cols))) for s in stats]
    return wide.select(*keys, F.explode(F.array(*each)).alias("_x")).select(*keys, "_x.*")


def tabstat(df: DataFrame, cols: list[str], stats: list[str], by: list[str] = (), weight: Column | None = None, wtype: str = "aweight") -> DataFrame:
    """(by, stat, one column a variable); null groups are dropped."""
    df = df.dropna(subset=[f"`{b}`" for b in by]) if by else df
    return _many(df, list(cols), list(stats), list(by), weight, wtype, "stat")


def tab1(df: DataFrame, col: str, weight: Column | None = None, missing: bool = False, sort: bool = False) -> DataFrame:
    """(value, freq, percent, cum) in the order of the values or, with ``sort``, from
    the most frequent on."""
    df = df if missing else df.filter(F.col(col).isNotNull())
    w = F.lit(1) if weight is None else F.when(weight > 0, weight)
    n = df.groupBy(col).agg(F.sum(w).alias("freq"))
    return _shares(n, ["-freq", col] if sort else [col])


def _shares(n: DataFrame, order_by: list[str]) -> DataFrame:
    """A table of groups with percent and cumulative percent."""
    total = n.agg(F.sum("freq")).first()[0] or 0
    run = running_total(n, order_by, F.col("freq"), "cum")
    return run.withColumns({"percent": F.try_divide(F.col("freq") * 100, F.lit(total)), "cum": F.try_divide(F.col("cum") * 100, F.lit(total))})


def tab2(df: DataFrame, a: str, b: str, weight: Column | None = None, missing: bool = False) -> DataFrame:
    """(a, b, margin, freq): cells and margins; margin is 0 for a cell, 1 for a
    total over b, 2 over a, 3 for the grand total."""
    df = df if missing else df.dropna(subset=[a, b])
    w = F.lit(1) if weight is None else F.when(weight > 0, weight)
    return df.cube(a, b).agg(F.grouping_id().cast("int").alias("margin"), F.sum(w).alias("freq"))


def collapse(
    df: DataFrame,
    specs: dict[str, tuple[str, str]],
    by: list[str] = (),
    weight: Column | None = None,
    wtype: str = "aweight",
    order_by: Column | None = None,
    keep_missing: bool = False,
) -> DataFrame:
    """Group statistics: new name -> (statistic, column)."""
    df = df.dropna(subset=[f"`{b}`" for b in by]) if by and not keep_missing else df
    return group_statistics(df, specs, by, weight, wtype, order_by)


def contract(df: DataFrame, *cols: str, freq: str = "freq", nomiss: bool = False) -> DataFrame:
    """One row a combination: frequency, cumulative frequency, percent (4 places)."""
    df = df.dropna(subset=list(cols)) if nomiss else df
    n = df.groupBy(*cols).agg(F.count("*").alias(freq))
    total = n.agg(F.sum(freq)).first()[0] or 0
    run = running_total(n, [f"-{freq}", *cols], F.col(freq), "cfreq")
    return run.withColumn("percent", F.round(F.try_divide(F.col(freq) * 100, F.lit(total)), 4))


def count_if(df: DataFrame, where: Column | None = None) -> DataFrame:
    return df.agg((F.count("*") if where is None else F.count_if(where)).alias("n"))


def codebook(df: DataFrame, *cols: str, top: int = 3) -> DataFrame:
    """(variable, label, n, missing, distinct_values, min, max, mean, sd, top, type,
    p25, p50, p75); moments and quartiles of numbers, and the ``top`` most frequent
    values with their counts.

    Each column is counted by its values first, so that one frequent value is one
    row and no column's values meet another's."""
    cols = list(cols) or df.columns
    numeric = [c for c in numeric_columns(df) if c in cols]
    meta = {f.name: f.metadata.get("label", "") for f in df.schema}
    parts = []
    for c in cols:
        v, k = F.col("v"), F.col("k")
        there = F.when(v.isNotNull(), k)
        levels = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("k"))
        best = levels.filter("v IS NOT NULL").orderBy(F.desc("k"), "v").limit(top).agg(F.sort_array(F.collect_list(F.struct((-k).alias("k"), "v"))).alias("_t"))
        text = F.array_join(F.transform("_t", lambda x: F.concat(x["v"].cast("string"), F.lit(" ("), (-x["k"]).cast("string"), F.lit(")"))), "; ")
        x = v.cast("double") if c in numeric else F.lit(None).cast("double")
        mean = F.try_divide(F.sum(x * there), F.sum(F.when(x.isNotNull(), there)))
        one = levels.agg(
            F.coalesce(F.sum(there), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(v.isNull(), k)), F.lit(0)).alias("missing"),
            F.count(v).alias("distinct_values"),
            F.min(v).cast("string").alias("min"),
            F.max(v).cast("string").alias("max"),
            mean.alias("mean"),
        )
        own = df.agg(F.stddev_samp(F.col(c).cast("double")).alias("sd")) if c in numeric else df.sparkSession.range(1).select(F.lit(None).cast("double").alias("sd"))
        # one row each
        joined = one.join(F.broadcast(best.select(text.alias("top")))).join(F.broadcast(own))
        parts.append(joined.select(F.lit(c).alias("variable"), F.lit(meta[c]).alias("label"), "n", "missing", "distinct_values", "min", "max", "mean", "sd", "top", F.lit(dict(df.dtypes)[c]).alias("type")))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    if not numeric:
        return out.withColumns({f"p{p}": F.lit(None).cast("double") for p in (25, 50, 75)})
    q = quantiles(df, numeric, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("p") == p / 100, F.col("q"))).alias(f"p{p}")
    return _null_safe(out, q.groupBy("variable").agg(at(25), at(50), at(75)), ["variable"], "left")


def levelsof(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).dropna().distinct().orderBy(col)


def distinct_count(df: DataFrame, *cols: str, approx: bool = False) -> DataFrame:
    one = F.struct(*cols)
    return df.dropna(subset=list(cols)).agg((F.approx_count_distinct(one) if approx else F.count_distinct(one)).alias("n_distinct"))


def assert_all(df: DataFrame, cond: Column) -> DataFrame:
    """(n, failed); ``check`` raises where any row fails."""
    return df.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(cond, F.lit(False))).alias("failed"))


def check(df: DataFrame, cond: Column) -> DataFrame:
    failed = assert_all(df, cond).first()["failed"]
    if failed:
        raise AssertionError(f"{failed} contradictions")
    return df


def correlate(df: DataFrame, *cols: str) -> DataFrame:
    """(a, b, n, r) of all pairs, each over its complete rows, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        aggs += [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{k}")]
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return df.agg(*aggs).select(F.inline(each))


def pwcorr(df: DataFrame, *cols: str, star: float = 0.05) -> DataFrame:
    """Correlations with p-values (t distribution, on the few rows of the table)."""
    spark, rows = df.sparkSession, []
    for r in correlate(df, *cols).filter("a <> b").collect():
        t = r["r"] * ((r["n"] - 2) / max(1 - r["r"] ** 2, 1e-300)) ** 0.5 if r["r"] is not None and r["n"] > 2 else None
        p = None if t is None else D.t_two_sided(t, r["n"] - 2)
        rows.append((r["a"], r["b"], r["n"], r["r"], p, p is not None and p < star))
    return spark.createDataFrame(rows, "a string, b string, n bigint, r double, p double, star boolean")


def ttest_one(df: DataFrame, col: str, mu: float) -> DataFrame:
    """(n, mean, sd, t, df, p)."""
    return _t_rows(df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd")), mu)


def _t_rows(stats: DataFrame, mu: float) -> DataFrame:
    r = stats.first()
    t = (r["mean"] - mu) / (r["sd"] / r["n"] ** 0.5) if r["n"] > 1 and r["sd"] else None
    p = None if t is None else D.t_two_sided(t, r["n"] - 1)
    return stats.sparkSession.createDataFrame([(r["n"], r["mean"], r["sd"], t, r["n"] - 1, p)], "n bigint, mean double, sd double, t double, df bigint, p double")


def ttest_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    return ttest_one(df.select((F.col(a) - F.col(b)).alias("d")), "d", 0.0)


def ttest_two(df: DataFrame, col: str, by: str) -> DataFrame:
    """(kind, difference, t, df, p) for pooled and unequal variances; the two
    least values of ``by`` are the groups."""
    rows = df.dropna(subset=[by]).groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("m"), F.var_samp(col).alias("v")).orderBy(by).limit(3).collect()
    if len(rows) != 2:
        raise ValueError(f"{by} has not exactly two values")
    (n1, m1, v1), (n2, m2, v2) = ((r["n"], r["m"], r["v"]) for r in rows)
    d = m1 - m2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    se = {"pooled": (pooled * (1 / n1 + 1 / n2)) ** 0.5, "welch": (v1 / n1 + v2 / n2) ** 0.5}
    dof = {"pooled": float(n1 + n2 - 2), "welch": (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))}
    out = [(k, d, d / se[k], dof[k], D.t_two_sided(d / se[k], dof[k])) for k in se]
    return df.sparkSession.createDataFrame(out, "kind string, difference double, t double, df double, p double")


def by_group(df: DataFrame, by: list[str], fn, schema: str) -> DataFrame:
    """Any Python function of a pandas frame, for each group."""
    return df.groupBy(*by).applyInPandas(fn, schema)
