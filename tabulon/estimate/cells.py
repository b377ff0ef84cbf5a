"""Two-way regressions on indicators of cohort x period cells, without a column a cell.

Cells of different cohorts never meet in one unit, so the normal equations of units,
periods, covariates and cells are blocks of one cohort each, bordered by periods and
covariates.  Units are eliminated by their means, blocks by a Schur complement.  What
the blocks need is counted by (cohort, period, period), from units of the same cohort
and the same observed periods together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stable
from .design import demean

#: Entries (cohort, period, period) that are read: 9 million of 24 bytes.
MAX_ENTRIES = 9_000_000
#: Combinations of cells whose errors are added up in one pass.
AT_ONCE = 24
ZERO = 1e-10


def _inverse(m: np.ndarray, scale: float) -> tuple[np.ndarray, int]:
    """A generalised inverse of a symmetric matrix, and its rank."""
    values, vectors = np.linalg.eigh(m)
    keep = values > ZERO * scale
    v = vectors[:, keep]
    return (v / values[keep]) @ v.T, int(keep.sum())


@dataclass
class CellFit:
    """Effects of the cells, and the variances of combinations of them."""

    cells: dict[tuple[int, int], tuple[float, int]]  # (cohort, period): effect, rows
    covariates: np.ndarray
    estimates: np.ndarray
    variances: np.ndarray
    n: int
    df_resid: float
    rss: float


class _Bordered:
    """The equations by cohort; ``solve`` takes right-hand sides as columns."""

    def __init__(self, border: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]]):
        self.parts, schur, self.rank = [], border.copy(), 0
        for own, beside in blocks:
            inverse, rank = _inverse(own, max(np.abs(own).max(initial=0.0), 1.0))
            self.parts.append((inverse, beside))
            self.rank += rank
            schur -= beside @ inverse @ beside.T
        self.schur, rank = _inverse(schur, max(np.abs(border).max(initial=0.0), 1.0))
        self.rank += rank

    def solve(self, border: np.ndarray, blocks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        rest = border - sum((b @ (a @ r) for (a, b), r in zip(self.parts, blocks, strict=True)), np.zeros_like(border))
        top = self.schur @ rest
        return top, [a @ (r - b.T @ top) for (a, b), r in zip(self.parts, blocks, strict=True)]


def _few(df: DataFrame, most: int, what: str):
    """All rows of a table of (cohort, period) entries as columns; an error where they are not few."""
    out = df.limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"more than {most} {what}")
    return out


def cell_regression(rows: DataFrame, k: int, combine, cluster: bool, max_cells: int, base: int = -1) -> CellFit:
    """Least squares of ``y`` on unit and period effects, the covariates x0 … x<k-1> and a
    dummy for each (g, t) with g not 0 and t - g not ``base``.

    ``rows`` are (u, t, g, y, x0 …) without nulls, g the same in all rows of a unit.
    ``combine`` takes [(g, t, rows)] and gives a matrix, a row for each combination of
    the cells whose variance is wanted; errors are clustered by unit or classical.
    Cells, or combinations, that the data do not tell apart get one of many solutions.
    """
    names = ["y", *(f"x{j}" for j in range(k))]
    per = rows.groupBy("u", "g", "t").agg(F.count("*").alias("c")).groupBy("u").agg(
        F.min("g").alias("g"), F.max("g").alias("_g"), F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("t", "c"))).alias("p")  # a period at most once
    )
    kinds = stable(per.groupBy("g", "_g", "n", "p").agg(F.count("*").alias("m")))
    if not kinds.filter("g <> _g").isEmpty():
        raise ValueError("the first treated period varies within a unit")
    sizes = _few(kinds.select("g", "m", F.explode("p").alias("p")).groupBy("g", "p.t").agg(F.sum(F.col("m") * F.col("p.c")).alias("n")), max_cells, "cells")
    pairs = kinds.select("g", "m", "n", "p", F.explode("p").alias("a")).select("g", "m", "n", "a", F.explode("p").alias("b"))
    pairs = _few(pairs.groupBy("g", F.col("a.t").alias("s"), F.col("b.t").alias("t")).agg(F.sum(F.col("m") * F.col("a.c") * F.col("b.c") / F.col("n")).alias("w")), MAX_ENTRIES, "entries of cohort, period and period")
    units = kinds.agg(F.sum("m")).first()[0] or 0

    times = sorted(set(sizes["t"].tolist()))
    at = {t: i for i, t in enumerate(times)}
    cohorts: dict = {}
    counts = {}
    for g, t, c in sorted(zip(sizes["g"].tolist(), sizes["t"].tolist(), sizes["n"].tolist(), strict=True)):
        cohorts.setdefault(g, []).append(t)
        counts[g, t] = int(c)
    p = {g: np.zeros((len(times), len(times))) for g in cohorts}
    for (g, t), c in counts.items():
        p[g][at[t], at[t]] += c
    for g, own in pairs.groupby("g"):
        p[g][own["s"].map(at).to_numpy(), own["t"].map(at).to_numpy()] -= own["w"].to_numpy(float)

    flat = stable(demean(rows, names, "u"))
    sums = _few(flat.groupBy("g", "t").agg(*(F.sum(c).alias(c) for c in names)), max_cells, "cells")
    by = {(g, t): v for g, t, *v in zip(*(sums[c].tolist() for c in sums.columns), strict=True)}
    cross = flat.agg(F.count("*"), *(F.sum(F.col(a) * F.col(b)) for a in names for b in names)).first()
    n, cross = cross[0], np.array([v or 0.0 for v in cross[1:]]).reshape(k + 1, k + 1)
    scale = np.sqrt(np.maximum(np.diag(cross)[1:] / max(n, 1), 0.0))
    scale[scale == 0] = 1.0

    # border: periods, then covariates over their scale
    m = len(times)
    border, right = np.zeros((m + k, m + k)), np.zeros(m + k)
    border[m:, m:] = cross[1:, 1:] / np.outer(scale, scale)
    right[m:] = cross[1:, 0] / scale
    treated = [g for g in sorted(cohorts) if g]
    cells = {g: [t for t in cohorts[g] if t - g != base] for g in treated}
    blocks, rights = [], []
    for g in cohorts:
        border[:m, :m] += p[g]
        for t in cohorts[g]:
            v = by[g, t]
            right[at[t]] += v[0]
            border[at[t], m:] += np.array(v[1:]) / scale
    border[m:, :m] = border[:m, m:].T
    for g in treated:
        i = [at[t] for t in cells[g]]
        x = np.array([by[g, t][1:] for t in cells[g]]).reshape(len(i), k).T / scale[:, None]
        blocks.append((p[g][np.ix_(i, i)], np.vstack([p[g][:, i], x])))
        rights.append(np.array([by[g, t][0] for t in cells[g]]))
    equations = _Bordered(border, blocks)
    top, found = equations.solve(right[:, None], [r[:, None] for r in rights])
    top, found = top[:, 0], [f[:, 0] for f in found]

    listed = [(g, t, counts[g, t]) for g in treated for t in cells[g]]
    w = combine(listed)
    cuts = np.cumsum([len(cells[g]) for g in treated])[:-1] if treated else []
    z_top, z = equations.solve(np.zeros((m + k, len(w))), np.split(w.T, cuts) if treated else [])
    effects = np.concatenate(found) if found else np.zeros(0)

    # residuals are those of y - x b - H, H by cohort and period, about the unit's mean
    place = {(g, t): (j, i) for j, g in enumerate(treated) for i, t in enumerate(cells[g])}

    def levels(g, t, border_part, block_part):
        own = place.get((g, t))
        return border_part[at[t]] + (block_part[own[0]][own[1]] if own else 0.0)

    f, rss, clusters = [], 0.0, 0
    keys = list(range(len(w))) if cluster else []
    b = top[m:] / scale
    spark, kind = rows.sparkSession, dict(rows.dtypes)
    for start in range(0, max(len(keys), 1), AT_ONCE):
        part = keys[start : start + AT_ONCE]
        table = [(g, t, float(levels(g, t, top, found)), *(float(levels(g, t, z_top[:, e], [x[:, e] for x in z])) for e in part)) for g in cohorts for t in cohorts[g]]
        table = spark.createDataFrame(table, f"g {kind['g']}, t {kind['t']}, fit double" + "".join(f", h{e} double" for e in part))
        a = F.col("y") - F.col("fit") - sum((F.col(f"x{j}") * float(v) for j, v in enumerate(b)), F.lit(0.0))
        beside = flat.join(F.broadcast(table), ["g", "t"]).withColumn("a", a)  # as many rows as cells, of AT_ONCE numbers
        sums = [F.count("*").alias("n"), F.sum("a").alias("s"), F.sum(F.col("a") * F.col("a")).alias("ss"), *(F.sum(F.col("a") * F.col(f"x{j}")).alias(f"ax{j}") for j in range(k))]
        sums += [s for e in part for s in (F.sum(f"h{e}").alias(f"h{e}"), F.sum(F.col("a") * F.col(f"h{e}")).alias(f"ah{e}"))]
        unit = beside.groupBy("u").agg(*sums)
        slope = [z_top[m:, e] / scale for e in part]
        score = [F.col(f"ah{e}") - F.col(f"h{e}") * F.col("s") / F.col("n") + sum((F.col(f"ax{j}") * float(v) for j, v in enumerate(s)), F.lit(0.0)) for e, s in zip(part, slope, strict=True)]
        got = unit.agg(F.count("*"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")), *(F.sum(s * s) for s in score)).first()
        clusters, rss = got[0], max(got[1] or 0.0, 0.0)
        f += [v or 0.0 for v in got[2:]]
    df = n - units - equations.rank
    if cluster:
        variances = np.array(f) * (clusters / (clusters - 1) * (n - 1) / df if clusters > 1 and df > 0 else np.nan)
    else:
        whole = np.concatenate(z) if z else np.zeros((0, len(w)))
        variances = np.einsum("ec,ce->e", w, whole) * (rss / df if df > 0 else np.nan)
    return CellFit({(g, t): (float(v), r) for (g, t, r), v in zip(listed, effects, strict=True)}, b, w @ effects, variances, n, df, rss)
