"""Design matrices as columns, and sums over them.

Columns are standardised in one pass before products are summed, which keeps
the digits of large values; ``Design.back`` maps coefficients back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import _joined

#: Levels of a factor up to which each is a column.
MAX_LEVELS = 1000
#: Up to so many columns, products are summed by built-in aggregates; beyond, the
#: generated code gets too large and partitions sum matrices from Arrow batches.
MAX_NATIVE = 24


class ManyLevels(ValueError):
    """A factor has more than MAX_LEVELS levels."""

    def __init__(self, factor: str):
        super().__init__(f"{factor} has more than {MAX_LEVELS} levels")
        self.factor = factor


@dataclass(frozen=True)
class Term:
    """A column, a level of a factor, or the constant."""

    name: str
    col: str | None = None
    level: object = None

    def value(self) -> Column:
        if self.col is None:
            return F.lit(1.0)
        return F.col(self.col).cast("double") if self.level is None else (F.col(self.col) == F.lit(self.level)).cast("double")


@dataclass
class Design:
    """Rows with _y, z0…z<k-1>, _w and further columns; complete cases only."""

    rows: DataFrame
    terms: list[Term]
    back: np.ndarray
    n: int
    weighted: bool
    sds: np.ndarray
    extras: list[str] = field(default_factory=list)

    @property
    def z(self) -> list[str]:
        return [f"z{j}" for j in range(len(self.terms))]


def terms_of(df: DataFrame, xs: list[str], factors: list[str] = (), constant: bool = True) -> list[Term]:
    """Terms; the first level of a factor is the base."""
    out = [Term(x, x) for x in xs]
    for f in factors:
        levels = [r[0] for r in df.select(f).dropna().distinct().orderBy(f).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ManyLevels(f)
        out += [Term(f"{v}.{f}", f, v) for v in levels[1:]]
    return [*out, Term("_cons")] if constant else out


def design(
    df: DataFrame,
    y: str,
    xs: list[str],
    factors: list[str] = (),
    constant: bool = True,
    weight: str | None = None,
    wtype: str = "aweight",
    extras: list[str] = (),
    offset: Column | None = None,
    terms: list[Term] | None = None,
) -> Design:
    used = [c for c in dict.fromkeys([y, *xs, *factors, *([weight] if weight else []), *extras]) if c]
    own = df.dropna(subset=used)
    if weight:
        own = own.filter(F.col(weight) > 0)
    terms = terms or terms_of(own, xs, factors, constant)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    off = offset.cast("double") if offset is not None else F.lit(0.0)
    flat = own.select(
        F.col(y).cast("double").alias("_y"), w.alias("_w"), off.alias("_o"), *(t.value().alias(f"x{j}") for j, t in enumerate(terms)), *(F.col(e).alias(f"_e_{e}") for e in extras)
    )
    k = len(terms)
    has_const = any(t.col is None for t in terms)
    aggs = [F.count("*"), F.sum("_w"), *(e for j in range(k) for e in (F.avg(f"x{j}"), F.stddev_samp(f"x{j}")))]
    row = flat.agg(*aggs).first()
    n, sw = row[0], row[1] or 0.0
    means = np.array([row[2 + 2 * j] or 0.0 for j in range(k)])
    sds = np.array([row[3 + 2 * j] or 0.0 for j in range(k)])
    const = np.array([t.col is None for t in terms])
    scale = np.where(const | (sds == 0), 1.0, sds)
    shift = np.where(const | (not has_const), 0.0, means)
    if weight and wtype in ("aweight", "pweight"):
        flat = flat.withColumn("_w", F.col("_w") * float(n / sw))
    zs = [((F.col(f"x{j}") - float(shift[j])) / float(scale[j])).alias(f"z{j}") for j in range(k)]
    rows = flat.select("_y", "_w", "_o", *zs, *(f"_e_{e}" for e in extras)).persist()
    back = np.diag(1 / scale)
    if has_const:
        c = int(np.argmax(const))
        back[c, :] -= np.where(const, 0.0, shift / scale)
    return Design(rows, terms, back, n, weight is not None, sds, list(extras))


def demean(df: DataFrame, cols: list[str], by: str, weight: str | None = None) -> DataFrame:
    """Columns less their group means, which are aggregated before the join."""
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.groupBy(by).agg(*(F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"_m_{c}") for c in cols))
    return _joined(df, means, [by]).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*(f"_m_{c}" for c in cols))


def _tri(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i + 1)]


def sums(rows: DataFrame, exprs: list[Column]) -> np.ndarray:
    if not exprs:
        return np.zeros(0)
    r = rows.agg(*(F.sum(e).alias(f"s{i}") for i, e in enumerate(exprs))).first()
    return np.array([x if x is not None else 0.0 for x in r], dtype=float)


def products(rows: DataFrame, cols: list[str], weight: Column | str = "_w") -> np.ndarray:
    """The matrix of sum(weight * a * b) over all pairs of columns."""
    k, w = len(cols), F.col(weight) if isinstance(weight, str) else weight
    if k > MAX_NATIVE:
        return _products_by_batches(rows.select(w.alias("_pw"), *cols), k)
    got = sums(rows, [w * F.col(cols[i]) * F.col(cols[j]) for i, j in _tri(k)])
    m = np.zeros((k, k))
    for (i, j), v in zip(_tri(k), got, strict=True):
        m[i, j] = m[j, i] = v
    return m


def _products_by_batches(rows: DataFrame, k: int) -> np.ndarray:
    def kernel(b: dict[str, np.ndarray]) -> np.ndarray:
        x = np.column_stack([v for n, v in b.items() if n != "_pw"])
        return (x * b["_pw"][:, None]).T @ x

    return batch_sums(rows, kernel, k * k).reshape(k, k)


def batch_sums(rows: DataFrame, kernel: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``kernel`` gives for a batch of columns; each
    partition sends ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += np.asarray(kernel({n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)})).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    got = rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def linear(cols: list[str], gamma: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, g in zip(cols, gamma, strict=True):
        out = out + F.col(c) * float(g)
    return out


def cluster_meat(rows: DataFrame, group: str, scores: list[Column]) -> tuple[np.ndarray, int]:
    """Outer products of the groups' score sums, and the number of groups."""
    k = len(scores)
    per = rows.groupBy(group).agg(*(F.sum(s).alias(f"u{j}") for j, s in enumerate(scores)))
    m = products(per.withColumn("_one", F.lit(1.0)), [f"u{j}" for j in range(k)], "_one")
    return m, per.count()
