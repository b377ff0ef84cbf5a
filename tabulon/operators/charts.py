"""The tables behind charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles, wide
from .summary import group_statistics


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n, density); default bins are sqrt(n) within 10 and 50."""
    r = df.agg(F.count(col), F.min(col), F.max(col)).first()
    n, low, high = r[0], r[1], r[2]
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint, density double")
    bins = bins or min(max(int(math.sqrt(n)), 10), 50)
    low, high = (float(low), float(high)) if high > low else (float(low) - 0.5, float(high) + 0.5)
    width = (high - low) / bins
    at = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, "bin", "left").fillna(0, ["n"])
    return out.select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n", (F.col("n") / (n * width)).alias("density"))


#: Bins to a bandwidth of the binned estimate, and bandwidths beyond which a kernel is nothing.
FINE, REACH = 64, 9


def kdensity(df: DataFrame, col: str, factor: float | None = None, points: int = 300, bins: int | None = None, exact: bool = False) -> DataFrame:
    """(x, density): a Gaussian kernel estimate from min - sd to max + sd.

    ``factor`` times the standard deviation is the bandwidth h, by default n^(-1/5).
    Each value is shared between the two grid points around it (linear binning), the
    grid has ``bins`` steps or ``FINE`` to a bandwidth, and what the points gather is
    convolved with the kernel where it is within ``REACH`` bandwidths.  The density is
    off by d^2 / (8 h^3 sqrt(2 pi)) at most, d being a step: 1 / 32,768 of a kernel's
    peak.  The convolution's work depends on ``points`` and ``FINE`` alone, not on
    how many values there are.  ``exact`` takes the distinct values as they are.

    Null and NaN values do not count.  Without two different values there is no
    bandwidth, and no row.
    """
    v = F.nanvl(F.col(f"`{col}`").cast("double"), F.lit(None).cast("double"))
    own = df.select(v.alias("v")).filter("v IS NOT NULL")
    r = own.agg(F.count("v"), F.min("v"), F.max("v"), F.stddev_samp("v")).first()
    if r[0] < 2 or not r[3]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    n, low, high, sd = r[0], float(r[1]), float(r[2]), float(r[3])
    h = (factor or n ** (-1 / 5)) * sd
    a, step = low - sd, (high - low + 2 * sd) / (points - 1)
    if exact:
        values = own.groupBy("v").agg(F.count("*").cast("double").alias("k"))
    else:
        d = (high - low) / (bins or math.ceil(FINE * (high - low) / h))
        at = (F.col("v") - low) / d
        cell = F.floor(at)
        shares = F.array(F.struct(cell.alias("b"), (1 - (at - cell)).alias("s")), F.struct((cell + 1).alias("b"), (at - cell).alias("s")))
        values = own.select(F.inline(shares)).groupBy("b").agg(F.sum("s").alias("k")).filter("k > 0").select((low + F.col("b") * d).alias("v"), "k")
    first = F.greatest(F.ceil((F.col("v") - REACH * h - a) / step), F.lit(0))
    last = F.least(F.floor((F.col("v") + REACH * h - a) / step), F.lit(points - 1))
    each = values.select("v", "k", F.explode(F.when(first <= last, F.sequence(first, last))).alias("i"))
    z = (F.col("v") - (a + F.col("i") * step)) / h
    dens = each.groupBy("i").agg((F.sum(F.col("k") * F.exp(-z * z / 2)) / (n * h * math.sqrt(2 * math.pi))).alias("d"))
    grid = df.sparkSession.range(points).select(F.col("id").alias("i"))
    return grid.join(dens, "i", "left").select((a + F.col("i") * step).alias("x"), F.coalesce("d", F.lit(0.0)).alias("density"))


def scatter(df: DataFrame, y: str, x: str, by: list[str] = (), cells: int = 50) -> DataFrame:
    """(by, cx, cy, x, y, n): points counted in a grid of cells, with mean places."""
    own = df.dropna(subset=[x, y])
    r = own.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    cut = lambda c, lo, hi: F.least(F.floor((F.col(c) - float(lo)) * cells / (float(hi - lo) or 1.0)), F.lit(cells - 1)).cast("int")
    if r[0] is None:
        r = (0, 1, 0, 1)
    return own.groupBy(*by, cut(x, r[0], r[1]).alias("cx"), cut(y, r[2], r[3]).alias("cy")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def linear_fit(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    """(by, slope, intercept, r2, n)."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def bar(df: DataFrame, col: str, over: list[str], stat: str = "mean", weight: Column | None = None, wtype: str = "aweight") -> DataFrame:
    return group_statistics(df.dropna(subset=over), {stat: (stat, col)}, over, weight, wtype)


def box(df: DataFrame, col: str, over: list[str] = ()) -> DataFrame:
    """(over, q1, median, q3, low, high, n_outside): whiskers at the last values
    within 1.5 interquartile ranges."""
    q = wide(quantiles(df, [col], [0.25, 0.5, 0.75], over), list(over), {"q1": (col, 0.25), "median": (col, 0.5), "q3": (col, 0.75)})
    from .windows import _joined

    rows = _joined(df.select(*over, F.col(col).cast("double").alias("_v")), q, list(over))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return rows.groupBy(*over, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"), F.count_if(F.col("_v").isNotNull() & ~inside).alias("n_outside")
    )


def line(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, x).agg(F.avg(y).alias(y)).orderBy(*by, x)


def fit_band(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, band): the band is 1.96 standard deviations of residuals."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("_s"), F.regr_r2(y, x).alias("_r"), F.regr_count(y, x).alias("_n"))
    return fit.select("slope", "intercept", (1.96 * F.sqrt(F.col("_s") * (1 - F.col("_r")) / F.col("_n"))).alias("band"))


def quadratic_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    from ..estimate.linear import ols

    fit = ols(df.withColumn("_x2", F.col(x) * F.col(x)), y, [x, "_x2"])
    return df.sparkSession.createDataFrame([(fit["_cons"], fit[x], fit["_x2"])], "c0 double, c1 double, c2 double")


def area(df: DataFrame, y: str, x: str) -> DataFrame:
    """(x, y, total): the line and its running total."""
    from .rows import running_total

    per = df.dropna(subset=[x, y]).groupBy(x).agg(F.sum(y).alias(y))
    return running_total(per, [x], F.col(y), "total")


