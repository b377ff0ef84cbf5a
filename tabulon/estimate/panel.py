"""Panels: description, fixed and random effects, two-way effects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import _joined
from ..storage import stable

from .design import demean
from .fit import Fit
from .linear import ols


def xtset(df: DataFrame, panel: str, time: str) -> DataFrame:
    """(n_panels, n_rows, t_min, t_max, t_mean, balanced)."""
    own = df.dropna(subset=[panel, time])
    per = own.groupBy(panel).agg(F.count("*").alias("t"), F.count_distinct(time).alias("d"))
    periods = own.agg(F.count_distinct(time).alias("periods"))
    one = per.agg(F.count("*").alias("n_panels"), F.sum("t").alias("n_rows"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("t").alias("t_mean"), F.min("d").alias("_d"))
    joined = one.join(F.broadcast(periods))  # one row each
    return joined.select("n_panels", "n_rows", "t_min", "t_max", "t_mean", ((F.col("_d") == F.col("periods")) & (F.col("t_max") == F.col("periods"))).alias("balanced"))


def xtreg_fe(df: DataFrame, y: str, xs: list[str], panel: str, vcov="classical") -> Fit:
    """Within estimates; degrees of freedom n - N - k."""
    own = df.dropna(subset=[panel, y, *xs]).select(panel, *(F.col(c).cast("double").alias(c) for c in (y, *xs)), *([F.col(vcov[1]).alias("_cl")] if isinstance(vcov, tuple) else []))
    groups = own.select(panel).distinct().count()
    within = demean(own, [y, *xs], panel)
    fit = ols(within, y, xs, vcov=("cluster", "_cl") if isinstance(vcov, tuple) else vcov, constant=False, df_used=groups)
    fit.kind = "fe"
    fit.stats["n_groups"] = groups
    return fit


def xtreg_re(df: DataFrame, y: str, xs: list[str], panel: str) -> Fit:
    """Random effects by the Swamy-Arora variance components."""
    own = stable(df.dropna(subset=[panel, y, *xs]).select(panel, *(F.col(c).cast("double").alias(c) for c in (y, *xs))))
    fe = xtreg_fe(own, y, xs, panel)
    n, groups, k = fe.n, int(fe.stats["n_groups"]), len(xs)
    s2e = fe.stats["rss"] / (n - groups - k)
    means = stable(own.groupBy(panel).agg(F.count("*").alias("_t"), *(F.avg(c).alias(c) for c in (y, *xs))))
    between = ols(means, y, xs)
    harmonic = groups / means.agg(F.sum(1 / F.col("_t"))).first()[0]
    s2u = max(between.stats["rss"] / (groups - k - 1) - s2e / harmonic, 0.0)
    theta = 1 - F.sqrt(F.lit(s2e) / (F.col("_t") * s2u + s2e))
    gm = means.select(panel, theta.alias("_theta"), *(F.col(c).alias(f"_m_{c}") for c in (y, *xs)))
    quasi = _joined(own, gm, [panel])
    quasi = quasi.withColumns({c: F.col(c) - F.col("_theta") * F.col(f"_m_{c}") for c in (y, *xs)} | {"_one": 1 - F.col("_theta")})
    fit = ols(quasi.select(y, *xs, "_one"), y, [*xs, "_one"], constant=False)
    fit.kind, fit.stats = "re", fit.stats | {"sigma2_e": s2e, "sigma2_u": s2u, "n_groups": groups}
    return fit


def is_balanced(df: DataFrame, unit: str, time: str) -> bool:
    r = df.agg(F.count("*"), F.count_distinct(F.struct(unit, time)), F.count_distinct(unit), F.count_distinct(time)).first()
    return r[0] == r[1] == r[2] * r[3]


#: Periods up to which the equations of their effects are solved on the driver.
MAX_PERIODS = 500


def two_way_solve(pairs: DataFrame, units: DataFrame, times: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(u, a0 … a<k-1>) and (t, b0 …): effects whose sums over the rows of ``pairs``
    (u, t) are, for each unit and each period, the given s0 … s<k-1>.

    Unit effects are eliminated, which leaves as many equations as there are periods;
    their matrix is one aggregate over the periods of each unit.
    """
    spark = pairs.sparkSession
    cells = pairs.groupBy("u", "t").agg(F.count("*").alias("c"))
    per = cells.groupBy("u").agg(F.collect_list(F.struct("t", "c")).alias("x"), F.sum("c").alias("n"))  # a period at most once
    per = stable(per.join(units, "u"))
    ts = [r["t"] for r in pairs.select("t").distinct().orderBy("t").limit(MAX_PERIODS + 1).collect()]
    if len(ts) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    at, m = {t: i for i, t in enumerate(ts)}, np.zeros((len(ts), len(ts)))
    each = per.select("n", "x", F.explode("x").alias("p")).select("n", "p", F.explode("x").alias("q"))
    for r in each.groupBy("p.t", "q.t").agg(F.sum(F.col("p.c") * F.col("q.c") / F.col("n"))).toDF("p", "q", "w").collect():
        m[at[r["p"]], at[r["q"]]] -= r["w"]
    for r in cells.groupBy("t").agg(F.sum("c").alias("n")).collect():
        m[at[r["t"]], at[r["t"]]] += r["n"]
    names = [f"s{j}" for j in range(k)]
    given, taken = np.zeros((len(ts), k)), np.zeros((len(ts), k))
    for r in times.select("t", *names).collect():
        if r["t"] in at:
            given[at[r["t"]]] = r[1:]
    shares = per.select(F.explode("x").alias("p"), *((F.col(s) / F.col("n")).alias(s) for s in names))
    for r in shares.groupBy("p.t").agg(*(F.sum(F.col("p.c") * F.col(s)) for s in names)).collect():
        taken[at[r[0]]] = r[1:]
    b = np.linalg.pinv(m, hermitian=True) @ (given - taken)
    kind = pairs.select("t").schema["t"].dataType.simpleString()
    found = spark.createDataFrame([(t, *map(float, b[i])) for t, i in at.items()], f"t {kind}" + "".join(f", b{j} double" for j in range(k)))
    total = per.select("u", F.explode("x").alias("p")).select("u", "p.t", "p.c").join(F.broadcast(found), "t")  # a row a period
    total = total.groupBy("u").agg(*(F.sum(F.col("c") * F.col(f"b{j}")).alias(f"b{j}") for j in range(k)))
    own = per.join(total, "u").select("u", *(((F.col(f"s{j}") - F.col(f"b{j}")) / F.col("n")).alias(f"a{j}") for j in range(k)))
    return own, found


def two_way_demean(df: DataFrame, cols: list[str], unit: str, time: str) -> DataFrame:
    """Columns without unit and time effects.

    On a balanced panel once by units and once by times is exact; else the effects
    are solved for.
    """
    if is_balanced(df, unit, time):
        return demean(demean(df, cols, unit), cols, time)
    df = stable(df)
    sums = lambda c, n: df.groupBy(F.col(c).alias(n)).agg(*(F.sum(x).alias(f"s{j}") for j, x in enumerate(cols)))
    units, times = two_way_solve(df.select(F.col(unit).alias("u"), F.col(time).alias("t")), sums(unit, "u"), sums(time, "t"), len(cols))
    out = _joined(df, units.withColumnRenamed("u", unit), [unit]).join(F.broadcast(times.withColumnRenamed("t", time)), time)
    return out.select(*(((F.col(c) - F.col(f"a{cols.index(c)}") - F.col(f"b{cols.index(c)}")).alias(c) if c in cols else F.col(c)) for c in df.columns))


def n_effects(df: DataFrame, unit: str, time: str) -> int:
    r = df.agg(F.count_distinct(unit), F.count_distinct(time)).first()
    return r[0] + r[1] - 1


def twoway(df: DataFrame, y: str, xs: list[str], unit: str, time: str, vcov="classical") -> Fit:
    """Two-way fixed effects; ``vcov`` "cluster" goes by unit, ("cluster", column) by another."""
    group = unit if vcov == "cluster" else vcov[1] if isinstance(vcov, tuple) else None
    more = [] if group is None or group in (unit, time) else [group]
    own = df.dropna(subset=[unit, time, y, *xs]).select(unit, time, *more, *(F.col(c).cast("double").alias(c) for c in (y, *xs)))
    flat = two_way_demean(own, [y, *xs], unit, time)
    fit = ols(flat, y, xs, vcov=vcov if group is None else ("cluster", group), constant=False, df_used=n_effects(own, unit, time))
    fit.kind = "twfe"
    return fit
