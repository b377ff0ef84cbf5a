"""Quantiles: linear (type 7) and on the midpoint grid, weighted; bins; trimming.

The midpoint grid puts the i-th of the sorted values at (W_i - w_i / 2) / W, W_i
being the running weight, with linear interpolation between and the extreme
values beyond.

All are exact.  Which plan finds them follows from the sizes of the groups, which
are counted first:

* groups of up to ``GROUP_ROWS`` rows are sorted, many of them to a task;
* a few large groups without weights are sketched: a mergeable quantile sketch
  brackets each order statistic, a second pass counts what lies below the brackets
  and keeps only the values inside (``selected``);
* otherwise equal values are added up and the weights summed by range, with an
  offset for each partition and segment (``rows.running_total``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import distributions as D
from .rows import _null_safe, running_total

#: Rows of a group that one task may sort; groups whose sketches go to the driver;
#: values inside the brackets that do; ranks a sketch may be wrong by, as a share.
GROUP_ROWS, MAX_GROUPS, NEAR_VALUES, SKETCH = 1_000_000, 5_000, 200_000, 10_000
ROUNDS = 8


def long_form(df: DataFrame, cols: list[str], by: list[str], weight: Column | None) -> DataFrame:
    """(_by0 …, variable, x, w): a row a value that counts.  Groups have names of their
    own here, so that theirs cannot clash."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    each = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols))
    keys = [f"_by{i}" for i in range(len(by))]
    own = df.select(*(F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)), w.alias("w"), F.explode(each).alias("_x")).select(*keys, "_x.variable", "_x.x", "w")
    return own.filter("x IS NOT NULL AND NOT isnan(x) AND w > 0")


def _in_order(long: DataFrame, ps: list[float], keys: list[str], midpoint: bool, weighted: bool, few: bool) -> DataFrame:
    """Groups of a bounded size, sorted; where there are ``few`` different values and no
    weights, equal ones are counted before.  Ties are taken in the order of the weights."""
    part = Window.partitionBy(*keys)
    before = Window.unboundedPreceding
    if few and not weighted:
        ties = long.groupBy(*keys, "x").agg(F.count("*").alias("k"))
        run = ties.select(*keys, "x", "k", F.sum("k").over(part.orderBy("x").rowsBetween(before, 0)).alias("cum"), F.sum("k").over(part).alias("n"))
        if not midpoint:
            return _pick7(run, ps, keys)
        return _pick(run.withColumns({"first": (F.col("cum") - F.col("k") + 0.5) / F.col("n"), "last": (F.col("cum") - 0.5) / F.col("n")}), ps, keys)
    order = part.orderBy("x", "w")
    if midpoint:
        grid = (F.sum("w").over(order.rowsBetween(before, 0)) - F.col("w") / 2) / F.sum("w").over(part)
        pts = long.select(*keys, "x", grid.alias("first")).withColumn("last", F.col("first"))
        return _pick(pts, ps, keys)
    ranked = long.select(*keys, "x", F.row_number().over(order).alias("cum"), F.count("*").over(part).alias("n"))
    return _pick7(ranked, ps, keys)


def _pick7(run: DataFrame, ps: list[float], keys: list[str]) -> DataFrame:
    """Linear between order statistics, from values, how many values are up to each
    (``cum``) and in all (``n``)."""
    at = lambda p: (F.col("n") - 1) * float(p)
    reach = lambda r: F.min(F.when(F.col("cum") > r, F.col("x")))
    aggs = [e for k, p in enumerate(ps) for e in (reach(F.floor(at(p))).alias(f"lo{k}"), reach(F.ceil(at(p))).alias(f"hi{k}"))]
    wide = run.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    q = lambda k, p: F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (at(p) - F.floor(at(p)))
    found = F.array(*(F.struct(F.lit(float(p)).alias("p"), q(k, p).alias("q")) for k, p in enumerate(ps)))
    return wide.select(*keys, F.explode(found).alias("_x")).select(*keys, "_x.p", "_x.q")


def _between(p: Column, g0: Column, x0: Column, g1: Column, x1: Column) -> Column:
    inside = x0 + (x1 - x0) * F.try_divide(p - g0, g1 - g0)
    return F.when(g0.isNull(), x1).when(g1.isNull(), x0).when(g1 <= g0, x1).otherwise(inside)


def _pick(pts: DataFrame, ps: list[float], keys: list[str]) -> DataFrame:
    """Quantiles from the last value whose first point is at or before each target and
    the first value whose last point is at or after it: one aggregate for all."""
    aggs = []
    for k, p in enumerate(ps):
        at = F.lit(float(p))
        aggs.append(F.max(F.when(F.col("first") <= at, F.struct("x", F.least("last", at).alias("g")))).alias(f"lo{k}"))
        aggs.append(F.min(F.when(F.col("last") >= at, F.struct("x", F.greatest("first", at).alias("g")))).alias(f"hi{k}"))
    wide = pts.groupBy(*keys).agg(*aggs)
    each = F.array(
        *(
            F.struct(F.lit(float(p)).alias("p"), _between(F.lit(float(p)), F.col(f"lo{k}.g"), F.col(f"lo{k}.x"), F.col(f"hi{k}.g"), F.col(f"hi{k}.x")).alias("q"))
            for k, p in enumerate(ps)
        )
    )
    return wide.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.p", "_x.q")


def _by_range(long: DataFrame, ps: list[float], keys: list[str], midpoint: bool) -> DataFrame:
    """Groups of any size: equal values first added up, so that one value in a third of
    all rows is one row, then summed by range.

    Within a run of ties all grid points have one value, so only the first and last
    points of a distinct value matter.
    """
    ties = long.groupBy(*keys, "x").agg(F.sum("w").alias("w"), F.min("w").alias("w0"), F.max("w").alias("w1"), F.count("*").alias("k"))
    if not midpoint:
        return _pick7(running_total(ties, ["x"], F.col("k"), "cum", keys, "n"), ps, keys)
    run = running_total(ties, ["x"], F.col("w"), "cum", keys, "total")
    first = (F.col("cum") - F.col("w") + F.col("w0") / 2) / F.col("total")
    return _pick(run.withColumns({"first": first, "last": (F.col("cum") - F.col("w1") / 2) / F.col("total")}), ps, keys)


def _targets(n: int, p: float, midpoint: bool) -> tuple[int, int]:
    """The order statistics, from 0, that the quantile lies between."""
    if not midpoint:
        return math.floor((n - 1) * p), math.ceil((n - 1) * p)
    grid = lambda i: (i + 0.5) / n
    low = min(max(math.floor(n * p - 0.5), 0), n - 1)
    while low + 1 < n and grid(low + 1) <= p:
        low += 1
    while low > 0 and grid(low) > p:
        low -= 1
    return (low, low) if grid(low) >= p or low + 1 >= n else (low, low + 1)


def _interpolated(n: int, p: float, midpoint: bool, r: tuple[int, int], x: tuple[float, float]) -> float:
    if not midpoint:
        return x[0] + (x[1] - x[0]) * ((n - 1) * p - math.floor((n - 1) * p))
    g = [(i + 0.5) / n for i in r]
    return x[0] if r[0] == r[1] else x[0] + (x[1] - x[0]) * (p - g[0]) / (g[1] - g[0])


def selected(long: DataFrame, ps: list[float], keys: list[str], midpoint: bool) -> DataFrame | None:
    """(keys, p, q) without weights, for a few groups of any size; None where
    the groups are more than ``MAX_GROUPS`` or the brackets do not close.

    A pass sketches every group and brackets each target.  The next counts the
    values below each bracket and collects those inside, equal ones once.  Where they
    are more than ``NEAR_VALUES`` the brackets are sketched again, inside.
    """
    spark = long.sparkSession
    shares = [x for p in ps for x in (max(p - 3 / SKETCH, 0.0), min(p + 3 / SKETCH, 1.0))]
    sketch = F.percentile_approx("x", F.array(*(F.lit(float(x)) for x in shares)), F.lit(SKETCH))
    groups = long.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), sketch.alias("s")).limit(MAX_GROUPS + 1).collect()
    if len(groups) > MAX_GROUPS:
        return None
    if not groups:
        return _by_range(long, ps, keys, midpoint)
    kinds = [long.schema[k] for k in keys]
    names = ", ".join(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(kinds))
    goals = {}  # (group, target) -> its order statistics
    span = {}  # (group, target) -> bracket
    for g, row in enumerate(groups):
        for k, p in enumerate(ps):
            goals[g, k] = _targets(row["n"], p, midpoint)
            low = row["low"] if shares[2 * k] == 0 else row["s"][2 * k]
            high = row["high"] if shares[2 * k + 1] == 1 else row["s"][2 * k + 1]
            span[g, k] = (low, high)
    found: dict[tuple[int, int], tuple[float, float]] = {}
    for _ in range(ROUNDS):
        rows = [(*(groups[g][key] for key in keys), g, [span[g, k][0] for k in range(len(ps))], [span[g, k][1] for k in range(len(ps))]) for g in range(len(groups))]
        brackets = spark.createDataFrame(rows, f"{names}, g int, lows array<double>, highs array<double>")
        met = long.join(F.broadcast(brackets), [F.col(f"`{k}`").eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)])  # MAX_GROUPS rows at most
        below = met.groupBy("g").agg(*(F.count_if(F.col("x") < F.get("lows", F.lit(k))).alias(f"b{k}") for k in range(len(ps)))).collect()
        before = {(r["g"], k): r[f"b{k}"] for r in below for k in range(len(ps))}
        here = F.filter(F.sequence(F.lit(0), F.lit(len(ps) - 1)), lambda k: (F.col("x") >= F.get("lows", k)) & (F.col("x") <= F.get("highs", k)))
        inside = met.select("g", "x", F.explode(here).alias("k"))
        values = inside.groupBy("g", "k", "x").agg(F.count("*").alias("m")).limit(NEAR_VALUES + 1).collect()
        if len(values) <= NEAR_VALUES:
            lists: dict = {}
            for r in values:
                lists.setdefault((r["g"], r["k"]), []).append((r["x"], r["m"]))
            for at, ranks in goals.items():
                own, upto, hit = sorted(lists.get(at, [])), before[at], {}
                if ranks[0] < upto:  # a sketch that was further off than it promises
                    continue
                for x, m in own:
                    upto += m
                    for r in ranks:
                        if r < upto and r not in hit:
                            hit[r] = x
                if len(hit) == len(set(ranks)):
                    found[at] = (hit[ranks[0]], hit[ranks[1]])
            missed = [at for at in goals if at not in found]
            if not missed:
                out = [(*(groups[g][key] for key in keys), float(ps[k]), _interpolated(groups[g]["n"], ps[k], midpoint, goals[g, k], found[g, k])) for g, k in goals]
                table = spark.createDataFrame(out, f"{names}, p double, q double")
                return table.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "p", "q")
            for g, k in missed:  # the whole group; later rounds close in again
                span[g, k] = (groups[g]["low"], groups[g]["high"])
            continue
        grid = F.percentile_approx("x", F.array(*(F.lit(i / 128) for i in range(129))), F.lit(SKETCH))
        closer = inside.groupBy("g", "k").agg(F.count("*").alias("n"), grid.alias("s")).collect()
        for r in closer:
            at, low, high = (r["g"], r["k"]), goals[r["g"], r["k"]][0] - before[r["g"], r["k"]], goals[r["g"], r["k"]][1] - before[r["g"], r["k"]]
            if 0 <= low and high < r["n"]:
                i, j = math.floor(low / r["n"] * 128) - 1, math.ceil((high + 1) / r["n"] * 128) + 1
                span[at] = (r["s"][i] if i > 0 else span[at][0], r["s"][j] if j < 128 else span[at][1])
            else:
                span[at] = (groups[r["g"]]["low"], groups[r["g"]]["high"])
    return None


def quantiles(df: DataFrame, cols: list[str], ps: list[float], by: list[str] = (), weight: Column | None = None, midpoint: bool = False) -> DataFrame:
    """(by, variable, p, q): quantiles of several columns in groups of any size.

    Null and NaN values do not count, nor do rows whose weight is null or not
    positive.  Groups without a value have no rows.
    """
    by = list(by)
    if by:
        kinds = [F.approx_count_distinct(F.col(f"`{c}`"), 0.1) for c in cols]
        sizes = df.groupBy(*(F.col(f"`{b}`") for b in by)).agg(F.count("*").alias("n"), sum(kinds, F.lit(0)).alias("d"))
        most, total, distinct = (x or 0 for x in sizes.agg(F.max("n"), F.sum("n"), F.sum("d")).first())
        few = 4 * distinct < total * len(cols)
    else:
        most, few = df.count(), False  # from the footers of Parquet files
    long = long_form(df, cols, by, weight)
    keys = [*(f"_by{i}" for i in range(len(by))), "variable"]
    if most <= GROUP_ROWS:
        out = _in_order(long, ps, keys, midpoint, weight is not None, few)
    else:
        out = selected(long, ps, keys, midpoint) if weight is None else None
        out = _by_range(long, ps, keys, midpoint) if out is None else out
    return out.select(*(F.col(f"_by{i}").alias(b) for i, b in enumerate(by)), "variable", "p", "q")


def quantile7(df: DataFrame, cols: list[str], ps: list[float], by: list[str] = ()) -> DataFrame:
    """(by, variable, p, q), exact and linear between order statistics."""
    return quantiles(df, cols, ps, by)


def quantile_mid(df: DataFrame, col: str, ps: list[float], by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, p, q) on the midpoint grid."""
    return quantiles(df, [col], ps, by, weight, midpoint=True).drop("variable")


def wide(q: DataFrame, by: list[str], named: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, one column a quantile) of a table of quantiles: name -> (variable, p)."""
    at = lambda v, p: F.max(F.when((F.col("variable") == v) & (F.col("p") == float(p)), F.col("q")))
    return q.groupBy(*(F.col(f"`{b}`") for b in by)).agg(*(at(*vp).alias(name) for name, vp in named.items()))


def beside(groups: DataFrame, q: DataFrame, by: list[str], named: dict[str, tuple[str, float]]) -> DataFrame:
    """``groups``, a row a group, with columns of quantiles."""
    table = wide(q, by, named)
    return _null_safe(groups, table, by, "left") if by else groups.join(F.broadcast(table))  # one row


def pctile(df: DataFrame, col: str, n: int = 4, percentiles: list[float] | None = None, weight: Column | None = None) -> DataFrame:
    """(p, q): the cut points of ``n`` classes, or given percentiles."""
    ps = [p / 100 for p in percentiles] if percentiles else [k / n for k in range(1, n)]
    return quantile_mid(df, col, ps, weight=weight)


def xtile(df: DataFrame, new: str, col: str, n: int = 4, cutpoints: list[float] | None = None, altdef: bool = False, weight: Column | None = None) -> DataFrame:
    """Class 1…n; a value at a cut point is in the upper class, with ``altdef``
    in the lower."""
    cuts = cutpoints or [r["q"] for r in pctile(df, col, n, weight=weight).collect()]
    x = F.col(col)
    cuts = sorted(c for c in cuts if c is not None)
    return df.withColumn(new, F.when(x.isNotNull(), _class(x, cuts, altdef, 1)))


def _class(x: Column, cuts: list[float], altdef: bool, base: int) -> Column:
    """``base`` and the number of cuts below, by halves: a comparison a doubling."""
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    above = x > cuts[m] if altdef else x >= cuts[m]
    return F.when(above, _class(x, cuts[m + 1 :], altdef, base + m + 1)).otherwise(_class(x, cuts[:m], altdef, base))


def winsor(
    df: DataFrame,
    cols: list[str],
    cuts: tuple[float, float] = (1, 99),
    by: list[str] = (),
    trim: bool = False,
    suffix: str | None = None,
    replace: bool = False,
    weight: Column | None = None,
) -> DataFrame:
    """Values beyond the cut percentiles drawn in to them, or made missing."""
    by = list(by)
    suffix = suffix or ("_tr" if trim else "_w")
    for c in cols:
        q = quantile_mid(df, c, [cuts[0] / 100, cuts[1] / 100], by, weight)
        lim = q.groupBy(*by).agg(F.min("q").alias("_lo"), F.max("q").alias("_hi"))
        x = F.col(c)
        if by:
            keyed = lim.select(*(F.col(b).alias(f"_{b}") for b in by), "_lo", "_hi")
            on = [df[b].eqNullSafe(keyed[f"_{b}"]) for b in by]
            out = df.join(keyed, on, "left")
            lo, hi = F.col("_lo"), F.col("_hi")
        else:
            r = lim.first()
            out, lo, hi = df, F.lit(r["_lo"]), F.lit(r["_hi"])
        value = F.when((x >= lo) & (x <= hi), x) if trim else F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))
        df = out.withColumn(c if replace else c + suffix, value).drop("_lo", "_hi", *(f"_{b}" for b in by))
    return df


def centile(df: DataFrame, col: str, centiles: list[float], level: float = 95, weight: Column | None = None) -> DataFrame:
    """(p, q, low, high): percentiles with intervals from order statistics."""
    ps = [c / 100 for c in centiles]
    base = quantile_mid(df, col, ps, weight=weight)
    own = df.select(F.col(col).cast("double").alias("x")).dropna()
    n = own.count()
    if not n:
        return base.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    tail = (1 - level / 100) / 2
    ranks = {p: (D.binomial_quantile(tail, n, p), D.binomial_quantile(1 - tail, n, p) + 1) for p in ps}
    wanted = sorted({min(max(r, 0), n - 1) for pair in ranks.values() for r in pair})
    # the r-th value from 0 stands at (r + 1/2) / n of the midpoint grid
    at = {r: (r + 0.5) / n for r in wanted}
    near = {r["p"]: r["q"] for r in quantile_mid(own, "x", list(at.values())).collect()}
    hit = {f"r{r}": near[share] for r, share in at.items()}
    rows = [(p, *(hit[f"r{min(max(r, 0), n - 1)}"] for r in ranks[p])) for p in ps]
    ci = df.sparkSession.createDataFrame(rows, "_p double, low double, high double")
    return base.join(F.broadcast(ci), base["p"] == ci["_p"]).drop("_p")
