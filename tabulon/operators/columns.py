"""Columns: creating, changing, choosing, recoding, labelling, reshaping."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import holds
from .rows import number_rows

TYPES = {"byte": "tinyint", "int": "smallint", "long": "int", "float": "float", "double": "double", "str": "string"}


def resolve(df: DataFrame, *patterns: str) -> list[str]:
    """Column names for names and ``*`` patterns, in the order of the patterns."""
    out: list[str] = []
    for p in patterns:
        found = [c for c in df.columns if fnmatchcase(c, p)]
        if not found:
            raise ValueError(f"no column {p}")
        out += [c for c in found if c not in out]
    return out


def generate(df: DataFrame, new: str, value: Column, where: Column | None = None, kind: str | None = None) -> DataFrame:
    """A new column; an existing one is an error."""
    if new in df.columns:
        raise ValueError(f"column {new} exists")
    value = value if where is None else F.when(holds(where), value)
    return df.withColumn(new, value.try_cast(TYPES[kind]) if kind else value)


def replace(df: DataFrame, col: str, value: Column, where: Column | None = None) -> DataFrame:
    resolve(df, col)
    return df.withColumn(col, value if where is None else F.when(holds(where), value).otherwise(F.col(col)))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Labels, kept as metadata, follow."""
    resolve(df, old)
    return df.withColumnRenamed(old, new)


def drop(df: DataFrame, *patterns: str) -> DataFrame:
    return df.drop(*resolve(df, *patterns))


def keep(df: DataFrame, *patterns: str) -> DataFrame:
    return df.select(*resolve(df, *patterns))


def drop_if(df: DataFrame, where: Column) -> DataFrame:
    """Rows with an unknown condition stay."""
    return df.filter(~holds(where))


def keep_if(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(where)


def order(df: DataFrame, *names: str, how: str = "first", at: str | None = None) -> DataFrame:
    """Columns moved first, last, before or after another, or all by alphabet."""
    if how == "alphabetical":
        return df.select(*sorted(df.columns))
    rest = [c for c in df.columns if c not in names]
    k = {"first": 0, "last": len(rest)}.get(how)
    if k is None:
        k = rest.index(at) + (how == "after")
    return df.select(*rest[:k], *names, *rest[k:])


def recode(df: DataFrame, col: str, rules: list[tuple[object, object]], new: str | None = None, simultaneous: bool = False) -> DataFrame:
    """Rules (from, to) with a value, a list, a (lo, hi) tuple or "else".

    Rules run one after another on what the rules before made, so that (1, 2),
    (2, 3) sends 1 to 3; "else" tests the source.  ``simultaneous`` tests the
    source in every rule, the first that holds wins.
    """
    source = F.col(col)

    def test(what: object, on: Column) -> Column:
        if isinstance(what, tuple):
            return on.between(*what)
        return on.isin(*what) if isinstance(what, list) else on == F.lit(what)

    named = [test(w, source) for w, _ in rules if w != "else"]
    out = source
    for what, to in reversed(rules) if simultaneous else rules:
        if what == "else":
            hit = source.isNotNull()
            for n in named:
                hit = hit & ~n
        else:
            hit = test(what, source if simultaneous else out)
        out = F.when(hit, F.lit(to)).otherwise(out)
    return df.withColumn(new or col, out)


def destring(df: DataFrame, *cols: str, force: bool = False) -> DataFrame:
    """Strings to numbers, without ``, $ %`` and white space.

    Without ``force`` a column with a value that is no number stays as it is;
    one aggregate over all columns finds this out.
    """
    clean = {c: F.regexp_replace(c, r"[,$%\s]", "").try_cast("double") for c in cols}
    if not force:
        bad = df.agg(*(F.count_if(F.col(c).isNotNull() & v.isNull()).alias(c) for c, v in clean.items())).first()
        clean = {c: v for c, v in clean.items() if not bad[c]}
    return df.withColumns(clean) if clean else df


def tostring(df: DataFrame, *cols: str, fmt: str | None = None) -> DataFrame:
    """Numbers to strings; missing becomes empty."""
    text = lambda c: F.format_string(fmt, F.col(c)) if fmt else F.col(c).cast("string")
    return df.withColumns({c: F.when(F.col(c).isNull(), "").otherwise(text(c)) for c in cols})


#: So many levels at most are kept as labels beside a column.
MAX_LABELS = 1000


def encode(df: DataFrame, col: str, new: str) -> DataFrame:
    """Codes 1…K of the sorted values, from a table of the distinct values; up to
    ``MAX_LABELS`` values become the value labels of ``new``."""
    codes = number_rows(df.select(F.col(col).alias("_v")).dropna().distinct(), ["_v"], new)
    codes = codes.withColumn(new, F.col(new).cast("int"))
    out = df.join(codes, df[col] == codes["_v"], "left").drop("_v")
    known = codes.orderBy(new).limit(MAX_LABELS + 1).collect()  # bounded by the limit
    return out if len(known) > MAX_LABELS else with_value_labels(out, new, {r[new]: str(r["_v"]) for r in known})


def with_value_labels(df: DataFrame, col: str, values: dict[object, str]) -> DataFrame:
    old = df.schema[col].metadata
    return df.withMetadata(col, old | {"value_labels": {str(k): v for k, v in values.items()}})


def with_label(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.withMetadata(col, df.schema[col].metadata | {"label": text})


def labels(df: DataFrame) -> dict[str, dict]:
    return {f.name: f.metadata for f in df.schema if f.metadata}


def decode(df: DataFrame, col: str, new: str) -> DataFrame:
    """The value labels of ``col`` as text; values without one as they are."""
    known = df.schema[col].metadata.get("value_labels", {})
    text = F.col(col).cast("string")
    if not known:
        return df.withColumn(new, text)
    pairs = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return df.withColumn(new, F.coalesce(F.try_element_at(pairs, text), text))


def split(df: DataFrame, col: str, stub: str, sep: str = " ", limit: int | None = None) -> DataFrame:
    """stub1…stubK, K the most parts of any row (one pass) or ``limit``."""
    import re

    parts = F.split(col, re.escape(sep))
    if limit is None:
        limit = df.agg(F.max(F.size(parts))).first()[0] or 0
    return df.withColumns({f"{stub}{k + 1}": F.get(parts, F.lit(k)) for k in range(limit)})


def clone(df: DataFrame, col: str, new: str) -> DataFrame:
    return df.withColumn(new, F.col(col))


def categories(df: DataFrame, *cols: str) -> DataFrame:
    """String columns with at most ``MAX_LABELS`` values, and half as many as rows, get
    these as ``categories`` beside the column; the files keep them as a dictionary."""
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string" and (not cols or f.name in cols)]
    if not strings:
        return df
    row = df.agg(F.count("*"), *(F.approx_count_distinct(c) for c in strings)).first()
    for c, many in zip(strings, row[1:], strict=True):
        if many * 2 <= row[0] and many <= 2 * MAX_LABELS:
            levels = [r[0] for r in df.select(c).dropna().distinct().orderBy(c).limit(MAX_LABELS + 1).collect()]
            if len(levels) <= MAX_LABELS:
                df = df.withMetadata(c, df.schema[c].metadata | {"categories": levels})
    return df


def compress(df: DataFrame, *cols: str) -> DataFrame:
    """Numbers in the smallest type that holds them all, found in one pass, and
    strings of few values as ``categories``."""
    df = categories(df, *cols)
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    chosen = [c for c in (cols or numeric) if c in numeric]
    if not chosen:
        return df
    exprs = [e for c in chosen for e in (F.min(c), F.max(c), F.count_if(F.col(c) != F.floor(c)))]
    row = df.agg(*exprs).first()
    out = {}
    for k, c in enumerate(chosen):
        low, high, fractions = row[3 * k : 3 * k + 3]
        if low is None or fractions:
            continue
        for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)):
            if -(1 << bits) <= low and high < 1 << bits:
                out[c] = F.col(c).cast(kind)
                break
    return df.withColumns(out) if out else df


def to_long(df: DataFrame, stubs: list[str], ids: list[str], j: str) -> DataFrame:
    """Stub columns ``stub<n>`` or ``stub_<n>`` to rows with ``n`` in ``j``."""
    suffix: dict[int, dict[str, str]] = {}
    for c in df.columns:
        for s in stubs:
            tail = c[len(s) :].removeprefix("_")
            if c.startswith(s) and tail.isdigit():
                suffix.setdefault(int(tail), {})[s] = c
    taken = {c for v in suffix.values() for c in v.values()}
    rest = [c for c in df.columns if c not in taken]
    rows = F.array(
        *(
            F.struct(F.lit(n).alias(j), *((F.col(v[s]) if s in v else F.lit(None)).alias(s) for s in stubs))
            for n, v in sorted(suffix.items())
        )
    )
    return df.select(*rest, F.explode(rows).alias("_x")).select(*rest, f"_x.{j}", *(f"_x.{s}" for s in stubs))


#: Columns that a wide table may have.
MAX_WIDE = 10_000


def to_wide(df: DataFrame, stubs: list[str], ids: list[str], j: str, values: list | None = None, check: bool = True) -> DataFrame:
    """Rows to columns ``stub<j>``; a repeated (ids, j) is an error, and so are more than
    ``MAX_WIDE`` columns, before the values of ``j`` come to the driver."""
    if check and not df.groupBy(*ids, j).count().filter("count > 1").isEmpty():
        raise ValueError(f"{ids} and {j} do not identify rows")
    others = [c for c in df.columns if c not in (*stubs, *ids, j)]
    if values is None:
        values = [r[0] for r in df.select(j).distinct().orderBy(j).limit(MAX_WIDE + 1).collect()]
    if len(values) * len(stubs) > MAX_WIDE:
        raise ValueError(f"{j} makes more than {MAX_WIDE} columns; keep it long, or name some values")
    cells = [F.first(F.when(F.col(j) == v, F.col(s)), ignorenulls=True).alias(f"{s}{v}") for v in values for s in stubs]
    first = [F.min_by(c, j).alias(c) for c in others]
    return df.groupBy(*ids).agg(*first, *cells)
