"""Difference in differences.

Rows are unit x time; ``first`` is a unit's first treated period, 0 or null for
never treated.  Cells, differences and influence functions are aggregates; only
tables of cohorts and periods reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..operators.quantiles import quantile7
from ..operators.windows import _joined
from ..storage import stable
from .cells import cell_regression
from .design import Term
from .fit import COEF, Fit
from .linear import ols
from .panel import two_way_solve, twoway


def first_treatment(df: DataFrame, d: str, unit: str, time: str) -> DataFrame:
    """``df`` with first_treat (0: never) and ever_treated."""
    per = df.groupBy(unit).agg(
        F.coalesce(F.min(F.when(F.col(d) == 1, F.col(time))), F.lit(0)).alias("first_treat"), F.coalesce(F.max(d), F.lit(0)).cast("int").alias("ever_treated")
    )
    return _joined(df, per, [unit])


def twfe(df: DataFrame, y: str, d: str, unit: str, time: str, vcov="classical") -> Fit:
    return twoway(df, y, [d], unit, time, vcov)


def post_indicator(df: DataFrame, time: str, post_periods: list | None = None, reference: object = None) -> Column:
    """Given periods, else later than the reference, else later than the median."""
    if post_periods is not None:
        return F.col(time).isin(post_periods).cast("int")
    if reference is None:
        middle = quantile7(df, [time], [0.5]).first()
        reference = middle["q"] if middle else None
    cut = reference
    return (F.col(time) > F.lit(cut)).cast("int")


def did2x2(df: DataFrame, y: str, treated: str, post: Column, covariates: list[str] = ()) -> DataFrame:
    """The difference of differences of four cells, or of a regression with covariates."""
    own = df.withColumn("_post", post)
    if covariates:
        own = own.withColumn("_inter", F.col(treated) * F.col("_post"))
        fit = ols(own, y, [treated, "_post", "_inter", *covariates])
        return fit.coefficients(df.sparkSession).filter("name = '_inter'").select(F.lit("did").alias("name"), "b", "se", "stat", "p", "low", "high")
    cells = own.dropna(subset=[y, treated]).groupBy(treated, "_post").agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    c = {(int(r[0]), int(r[1])): r for r in cells.collect() if r[1] is not None}
    if missing := [f"{treated} = {i}, post = {j}" for i in (0, 1) for j in (0, 1) if (i, j) not in c]:
        raise ValueError(f"no rows with {'; '.join(missing)}")
    b = (c[1, 1]["m"] - c[1, 0]["m"]) - (c[0, 1]["m"] - c[0, 0]["m"])
    rss = sum((r["n"] - 1) * (r["v"] or 0) for r in c.values())
    n = sum(r["n"] for r in c.values())
    var = rss / (n - 4) * sum(1 / r["n"] for r in c.values()) if n > 4 else math.nan
    fit = Fit("did", y, [], np.array([b]), np.array([[var]]), n, n - 4)
    return df.sparkSession.createDataFrame([fit._row("did", b, var, 95)], COEF)


def _cohorts(df: DataFrame, first: str) -> list:
    own = df.select(F.coalesce(F.col(first), F.lit(0)).alias("g")).distinct().orderBy("g")
    return [r["g"] for r in _small(own) if r["g"]]


#: Cells (cohort x period) of a panel up to which their table is broadcast and read.
MAX_CELLS = 100_000
EFFECT = "key int, att double, se double, stat double, p double, low double, high double, n bigint"


def _small(df: DataFrame, most: int = MAX_CELLS) -> list:
    """All rows of a table of cohorts, periods or cells; an error where they are not few."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cohorts, periods or cells")
    return rows


def _panel(df: DataFrame, y: str, unit: str, time: str, first: str, covariates: list[str]) -> DataFrame:
    own = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(first), F.lit(0)).alias("g"), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(covariates)))
    return own.dropna()


def _bases(own: DataFrame, always: str) -> list[tuple]:
    """(cohort, base): the last period before treatment in which both the cohort and
    the never treated are observed, so that periods need not follow each other.

    Cohorts without one, treated from the start, are an error or, with ``always``
    "drop", left out.
    """
    seen: dict = {}
    for r in _small(own.select("g", "t").distinct()):
        seen.setdefault(r["g"], set()).add(r["t"])
    never, bases, without = seen.get(0, set()), [], []
    for g in sorted(g for g in seen if g):
        before = [t for t in seen[g] & never if t < g]
        bases.append((g, max(before))) if before else without.append(g)
    if without and never and always != "drop":
        raise ValueError(f"cohorts {without} are not observed before their treatment beside never-treated units")
    return bases


def _differences(own: DataFrame, k: int, always: str = "raise") -> DataFrame:
    """(u, cohort, t, g, d, x0 …): long differences from the last period observed before
    treatment, of each cohort and of the never treated; ``x`` are the covariates then."""
    bases = own.sparkSession.createDataFrame(_bases(own, always) or [(0, 0)], "cohort int, base int")
    # each unit's base outcome, for its own cohort or, if never treated, for all
    pre = own.join(F.broadcast(bases), own["t"] == F.col("base")).filter((F.col("g") == F.col("cohort")) | (F.col("g") == 0))
    pre = pre.select("u", "cohort", F.col("y").alias("y0"), *(f"x{j}" for j in range(k)))
    return own.select("u", "t", "y", "g").join(pre, "u").withColumn("d", F.col("y") - F.col("y0"))


def _cells(d: DataFrame, k: int) -> dict[tuple[int, int], dict]:
    """For each (cohort, t): the effect, the numbers of both groups, the coefficients
    of the never treated and what their influence is scaled by.

    The outcome regression of the never treated on a constant and the covariates
    predicts the treated; without covariates it is their mean.
    """
    x = [F.lit(1.0), *(F.col(f"x{j}") for j in range(k))]
    treated = F.col("g") != 0
    of = lambda e, on: F.sum(F.when(on, e))
    aggs = [F.count_if(treated), F.count_if(~treated), of(F.col("d"), treated)]
    aggs += [of(c, treated) for c in x] + [of(c * F.col("d"), ~treated) for c in x] + [of(a * b, ~treated) for a in x for b in x]
    out = {}
    m = len(x)
    for r in _small(d.groupBy("cohort", "t").agg(*aggs)):
        n1, n0 = r[2], r[3]
        if not n1 or not n0:
            continue
        v = np.array(r[4:], float)
        mean, xd, xx = v[1 : 1 + m] / n1, v[1 + m : 1 + 2 * m], v[1 + 2 * m :].reshape(m, m)
        inverse = np.linalg.pinv(xx, hermitian=True)
        beta = inverse @ xd
        out[r[0], r[1]] = {"n1": n1, "n0": n0, "att": v[0] / n1 - mean @ beta, "beta": beta, "scale": inverse @ mean}
    return out


def _influence(d: DataFrame, cells: dict, keys: dict[tuple[int, int], list[tuple[int, float]]], k: int) -> dict[int, float]:
    """Standard errors of the weighted sums of cells named by ``keys``; influence is
    added up a unit, so that correlation over cells and periods counts."""
    rows = [
        (g, t, key, float(w), float(c["att"]), int(c["n1"]), [float(b) for b in c["beta"]], [float(s) for s in c["scale"]])
        for (g, t), c in cells.items()
        for key, w in keys.get((g, t), [])
    ]
    if not rows:
        return {}
    table = d.sparkSession.createDataFrame(rows, "cohort int, t int, key int, w double, att double, n1 bigint, beta array<double>, scale array<double>")
    x = [F.lit(1.0), *(F.col(f"x{j}") for j in range(k))]
    dot = lambda name: sum((F.get(name, F.lit(j)) * c for j, c in enumerate(x)), F.lit(0.0))
    rest = F.col("d") - dot("beta")
    inf = F.when(F.col("g") != 0, (rest - F.col("att")) / F.col("n1")).otherwise(-dot("scale") * rest)
    own = d.withColumn("t", F.col("t").cast("int")).join(F.broadcast(table), ["cohort", "t"])  # MAX_CELLS bounds it
    per = own.groupBy("u", "key").agg(F.sum(F.col("w") * inf).alias("f"))
    return {r["key"]: math.sqrt(r["v"]) for r in per.groupBy("key").agg(F.sum(F.col("f") * F.col("f")).alias("v")).collect()}


def _effect_row(key: int, att: float, se: float | None, n: int, level: float = 95) -> tuple:
    row = Fit("did", "", [], np.array([att]), np.zeros((1, 1)), n)._row("", att, (se or 0.0) ** 2, level)
    return (int(key), *row[1:], int(n))


def att_gt(df: DataFrame, y: str, unit: str, time: str, first: str, covariates: list[str] = (), always: str = "raise") -> DataFrame:
    """(g, t, att, se, n): differences from the last period observed before treatment,
    against never-treated units (Callaway and Sant'Anna), with covariates by
    regression.  ``always`` is "raise" or "drop" for cohorts never seen untreated."""
    k = len(covariates)
    d = stable(_differences(_panel(df, y, unit, time, first, list(covariates)), k, always))
    cells = _cells(d, k)
    order = sorted(cells)
    ses = _influence(d, cells, {c: [(i, 1.0)] for i, c in enumerate(order)}, k)
    rows = [(int(g), int(t), float(cells[g, t]["att"]), ses.get(i), int(cells[g, t]["n1"])) for i, (g, t) in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "g int, t int, att double, se double, n bigint")


def callaway_santanna(df: DataFrame, y: str, unit: str, time: str, first: str, aggregate: str = "simple", covariates: list[str] = (), level: float = 95, always: str = "raise") -> DataFrame:
    """(key, att, se, stat, p, low, high, n): simple, group or event_study aggregates
    of ATT(g, t), by the numbers of treated units."""
    k = len(covariates)
    d = stable(_differences(_panel(df, y, unit, time, first, list(covariates)), k, always))
    cells = _cells(d, k)
    name = {"simple": lambda g, t: 0, "group": lambda g, t: g, "event_study": lambda g, t: t - g}[aggregate]
    used = {c: name(*c) for c in cells if aggregate == "event_study" or c[1] >= c[0]}
    total: dict[int, int] = {}
    for c, key in used.items():
        total[key] = total.get(key, 0) + cells[c]["n1"]
    keys = {c: [(key, cells[c]["n1"] / total[key])] for c, key in used.items()}
    ses = _influence(d, cells, keys, k)
    att = {key: sum(cells[c]["att"] * keys[c][0][1] for c in used if used[c] == key) for key in total}
    return df.sparkSession.createDataFrame([_effect_row(key, att[key], ses.get(key), total[key], level) for key in sorted(total)], EFFECT)


def simple_att_se(df: DataFrame, y: str, unit: str, time: str, first: str) -> float:
    """The standard error of the simple aggregate."""
    return callaway_santanna(df, y, unit, time, first).first()["se"]


def sun_abraham(df: DataFrame, y: str, unit: str, time: str, first: str, covariates: list[str] = (), vcov="cluster", level: float = 95) -> DataFrame:
    """(e, att, se, stat, p, low, high, n): cohort x relative-time effects of one
    two-way regression, mixed with the cohorts' numbers of rows; relative time -1 is
    the base.  Errors are clustered by unit or, with ``vcov`` "classical", not.

    The equations are solved a cohort at a time (``cells``), so some ten thousand
    cells are no matrix of that width; ``first`` must not vary within a unit.
    """
    if vcov not in ("cluster", "classical"):
        raise ValueError(f"no errors of kind {vcov}")
    own = _panel(df, y, unit, time, first, list(covariates))
    keys: list[int] = []
    rows: list[int] = []

    def combine(cells: list[tuple[int, int, int]]) -> np.ndarray:
        keys.extend(sorted({t - g for g, t, _ in cells}))
        w = np.zeros((len(keys), len(cells)))
        for j, (g, t, n) in enumerate(cells):
            w[keys.index(t - g), j] = n
        rows.extend(int(n) for n in w.sum(axis=1))
        return w / w.sum(axis=1, keepdims=True)

    fit = cell_regression(own, len(covariates), combine, vcov == "cluster", MAX_CELLS)
    out = [_effect_row(e, float(b), float(np.sqrt(max(v, 0.0))), n, level) for e, b, v, n in zip(keys, fit.estimates, fit.variances, rows, strict=True)]
    return df.sparkSession.createDataFrame(out, EFFECT).withColumnRenamed("key", "e")


def _untreated_effects(own: DataFrame) -> DataFrame:
    """(u, t, y, d, …, y0): two-way effects fitted on untreated rows."""
    free = own.filter("d = 0")
    sums = lambda c: free.groupBy(c).agg(F.sum("y").alias("s0"))
    units, times = two_way_solve(free, sums("u"), sums("t"), 1)
    return own.join(units, "u").join(F.broadcast(times), "t").withColumn("y0", F.col("a0") + F.col("b0")).drop("a0", "b0")


def _treated_panel(df: DataFrame, y: str, d: str, unit: str, time: str, covariates: list[str]) -> DataFrame:
    """(u, t, y, d, g): rows with ``y`` less the covariates' part, which comes from the
    two-way regression of the untreated rows."""
    own = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(y).cast("double").alias("y"), F.col(d).cast("int").alias("d"), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(covariates))).dropna()
    first = own.groupBy("u").agg(F.coalesce(F.min(F.when(F.col("d") == 1, F.col("t"))), F.lit(0)).alias("g"))
    own = stable(own.join(first, "u"))
    if covariates:
        fit = twoway(own.filter("d = 0"), "y", [f"x{j}" for j in range(len(covariates))], "u", "t")
        own = own.withColumn("y", F.col("y") - sum((F.col(f"x{j}") * float(b) for j, b in enumerate(fit.b)), F.lit(0.0)))
    return stable(own.select("u", "t", "y", "d", "g"))


def imputation(df: DataFrame, y: str, d: str, unit: str, time: str, aggregate: str = "simple", covariates: list[str] = (), level: float = 95) -> DataFrame:
    """(key, att, se, stat, p, low, high, n): Borusyak, Jaravel and Spiess: outcomes
    less imputed untreated ones; simple, group or event_study.

    The estimate is a weighted sum of outcomes; the weights of untreated rows solve
    the same two-way equations.  Errors add up weights times residuals a unit, those
    of treated rows about their cohort's mean at the time.  With covariates their
    coefficients count as known.
    """
    own = _treated_panel(df, y, d, unit, time, list(covariates))
    full = stable(_untreated_effects(own))
    key = {"simple": F.lit(0), "group": F.col("g"), "event_study": F.col("t") - F.col("g")}[aggregate].cast("int")
    rest = full.withColumns({"r": F.col("y") - F.col("y0"), "key": key})
    keys = _small(rest.filter("d = 1").groupBy("key").agg(F.avg("r").alias("att"), F.count("*").alias("n")).orderBy("key"))
    about = rest.filter("d = 1").groupBy("g", "t").agg(F.avg("r").alias("m"))
    centred = rest.join(about, ["g", "t"], "left").withColumn("e", F.when(F.col("d") == 1, F.col("r") - F.col("m")).otherwise(F.col("r")))
    centred = stable(centred.select("u", "t", "d", "key", "e"))
    # the weights of all keys are solved for together
    w = [F.when((F.col("d") == 1) & (F.col("key") == k["key"]), F.lit(1.0 / k["n"])).otherwise(0.0) for k in keys]
    need = lambda c: centred.groupBy(c).agg(*(F.sum(x).alias(f"s{j}") for j, x in enumerate(w)))
    a, b = two_way_solve(full.filter("d = 0"), need("u"), need("t"), len(keys))
    v = [F.when(F.col("d") == 0, -(F.col(f"a{j}") + F.col(f"b{j}"))).otherwise(x) for j, x in enumerate(w)]
    per = centred.join(a, "u").join(F.broadcast(b), "t").groupBy("u").agg(*(F.sum(x * F.col("e")).alias(f"f{j}") for j, x in enumerate(v)))
    var = per.agg(*(F.sum(F.col(f"f{j}") * F.col(f"f{j}")) for j in range(len(keys)))).first()
    rows = [_effect_row(k["key"], k["att"], math.sqrt(x or 0.0), k["n"], level) for k, x in zip(keys, var, strict=True)]
    return df.sparkSession.createDataFrame(rows, EFFECT)


def _by_relative_time(rows: DataFrame, e: Column) -> tuple[DataFrame, list[Term]]:
    """``rows`` with a dummy for each period since treatment, and their terms."""
    rows = stable(rows.withColumn("_e", e))
    found = [r["_e"] for r in _small(rows.select("_e").dropna().distinct().orderBy("_e"))]
    names = {f"_e{k}": v for k, v in enumerate(found)}
    rows = rows.withColumns({c: F.coalesce((F.col("_e") == v).cast("double"), F.lit(0.0)) for c, v in names.items()})
    return rows, [Term(f"e{v:+d}", c) for c, v in names.items()]


def gardner(df: DataFrame, y: str, d: str, unit: str, time: str, aggregate: str = "simple", covariates: list[str] = ()) -> Fit:
    """Two stages: effects from untreated rows, then residuals on treatment, or on the
    periods since treatment with "event_study"; errors clustered by unit."""
    rest = _untreated_effects(_treated_panel(df, y, d, unit, time, list(covariates))).withColumn("_r", F.col("y") - F.col("y0"))
    if aggregate == "event_study":
        rest, terms = _by_relative_time(rest, F.when(F.col("d") == 1, F.col("t") - F.col("g")).cast("int"))
        fit = ols(rest, "_r", [t.col for t in terms], vcov=("cluster", "u"), constant=False, terms=terms)
    else:
        fit = ols(rest, "_r", ["d"], vcov=("cluster", "u"), constant=False)
    fit.kind = "gardner"
    return fit


def stacked(df: DataFrame, y: str, unit: str, time: str, first: str, window: tuple[int, int] = (-3, 3), aggregate: str = "simple", vcov="classical") -> Fit:
    """One sub-experiment a cohort with controls untreated in the whole window,
    stacked, with stack x unit and stack x time effects; with "event_study" one
    effect a relative period, -1 being the base.  ``vcov`` "cluster" goes by unit."""
    own = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(first), F.lit(0)).alias("g")).dropna()
    cohorts = own.sparkSession.createDataFrame([(int(g),) for g in _cohorts(own, "g")] or [(0,)], "stack int")  # few, by _cohorts
    e = F.col("t") - F.col("stack")
    rows = own.join(F.broadcast(cohorts), (F.col("g") == F.col("stack")) | (F.col("g") == 0) | (F.col("g") > F.col("stack") + window[1]))
    treated = F.col("g") == F.col("stack")
    rows = rows.filter(e.between(*window)).withColumns({"d": (treated & (e >= 0)).cast("double"), "su": F.struct("stack", "u").cast("string"), "st": F.struct("stack", "t").cast("string")})
    vcov = ("cluster", "u") if vcov == "cluster" else vcov
    if aggregate == "event_study":
        rows, terms = _by_relative_time(rows, F.when(treated & (e != -1), e).cast("int"))
        fit = twoway(rows, "y", [t.col for t in terms], "su", "st", vcov)
        fit.terms = terms
    else:
        fit = twoway(stable(rows), "y", ["d"], "su", "st", vcov)
    fit.kind = "stacked"
    return fit


def event_study(df: DataFrame, y: str, ever: str, time: str, reference: object) -> DataFrame:
    """(period, effect, se): difference of group means less that of the reference."""
    cells = df.groupBy(time).agg(
        *(f(F.when(F.col(ever) == k, F.col(y))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))
    )
    gap = cells.select(F.col(time).alias("period"), (F.col("m1") - F.col("m0")).alias("gap"), (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")).alias("var"))
    ref = gap.filter(F.col("period") == F.lit(reference)).select(F.col("gap").alias("_g"), F.col("var").alias("_v"))
    out = gap.join(F.broadcast(ref))  # one row
    same = F.col("period") == F.lit(reference)
    return out.select("period", (F.col("gap") - F.col("_g")).alias("effect"), F.when(same, 0.0).otherwise(F.sqrt(F.col("var") + F.col("_v"))).alias("se"))


def bacon(df: DataFrame, y: str, unit: str, time: str, first: str) -> DataFrame:
    """(kind, treated, control, estimate, weight) of a balanced panel; weights
    sum to one and the weighted estimates to the two-way estimate."""
    own = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(first), F.lit(0)).alias("g"))
    m, size = {}, {}
    for r in _small(own.groupBy("g", "t").agg(F.avg("y").alias("m"), F.count("*").alias("n"))):  # cohorts x periods
        m[r["g"], r["t"]], size[r["g"]] = r["m"], r["n"]
    times = sorted({t for _, t in m})
    total = sum(size.values())
    share = {g: n / total for g, n in size.items()}
    dbar = {g: sum(t >= g for t in times) / len(times) if g else 0.0 for g in size}
    mean = lambda g, ts: float(np.mean([m[g, t] for t in ts]))
    rows = []
    for k in sorted(size):
        for c in sorted(size):
            if k == 0 or k == c or not 0 < dbar[k] < 1:
                continue
            n = share[k] + share[c]
            part = share[k] / n
            if c == 0:
                pre, post = [t for t in times if t < k], [t for t in times if t >= k]
                w, kind = n * n * part * (1 - part) * dbar[k] * (1 - dbar[k]), "treated vs never"
            elif k < c:
                pre, post = [t for t in times if t < k], [t for t in times if k <= t < c]
                dk, dc = dbar[k], dbar[c]
                w, kind = (n * (1 - dc)) ** 2 * part * (1 - part) * (dk - dc) * (1 - dk) / (1 - dc) ** 2, "earlier vs later"
            else:
                pre, post = [t for t in times if c <= t < k], [t for t in times if t >= k]
                dk, dc = dbar[c], dbar[k]
                w, kind = (n * dk) ** 2 * part * (1 - part) * dc * (dk - dc) / dk**2, "later vs earlier"
            if pre and post:
                est = mean(k, post) - mean(k, pre) - (mean(c, post) - mean(c, pre))
                rows.append((kind, int(k), int(c), est, w))
    sw = sum(r[-1] for r in rows) or 1.0
    return df.sparkSession.createDataFrame([(*r[:-1], float(r[-1] / sw)) for r in rows], "kind string, treated int, control int, estimate double, weight double")


def did(df: DataFrame, y: str, d: str, unit: str, time: str, method: str, first: str | None = None, **options):
    """Dispatch by the method's name; ``first`` is derived from ``d`` if not given."""
    if first is None and method in ("cs", "sa", "stacked", "bacon"):
        df, first = first_treatment(df, d, unit, time), "first_treat"
    spark = df.sparkSession
    if method == "twfe":
        return twfe(df, y, d, unit, time, **options).coefficients(spark)
    if method == "did":
        own = first_treatment(df, d, unit, time) if "ever_treated" not in df.columns else df
        return did2x2(own, y, "ever_treated", post_indicator(own, time, options.get("post_periods"), options.get("reference_period")), options.get("covariates", ()))
    aggregate, covariates = options.get("aggregate", "simple"), options.get("covariates", ())
    if method == "cs":
        return callaway_santanna(df, y, unit, time, first, aggregate, covariates)
    if method == "sa":
        return sun_abraham(df, y, unit, time, first, covariates)
    if method == "bjs":
        return imputation(df, y, d, unit, time, aggregate, covariates)
    if method == "gardner":
        return gardner(df, y, d, unit, time, aggregate, covariates).coefficients(spark)
    if method == "stacked":
        return stacked(df, y, unit, time, first, aggregate=aggregate).coefficients(spark)
    if method == "eventstudy":
        own = first_treatment(df, d, unit, time) if "ever_treated" not in df.columns else df
        return event_study(own, y, "ever_treated", time, options["reference_period"])
    if method == "bacon":
        return bacon(df, y, unit, time, first)
    raise ValueError(f"no method {method}")


