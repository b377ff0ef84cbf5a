"""Scalar functions: Column in, Column out, all evaluated in the JVM.

Missing is null.  What NumPy gives as infinity or NaN (division by zero, the
logarithm of a number that is not positive) is missing here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null for NaN and the infinities."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(x)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def power(a: Column, b: Column) -> Column:
    return finite(F.pow(a, b))


def ne_missing(a: Column, b: Column) -> Column:
    """Unequal, where missing differs from every value."""
    return ~a.eqNullSafe(b)


def holds(c: Column) -> Column:
    """A condition with unknown counted as false."""
    return F.coalesce(c, F.lit(False))


def missing(x: Column) -> Column:
    return x.isNull()


def inrange(x: Column, lo, hi) -> Column:
    return x.between(lo, hi)


def inlist(x: Column, *values) -> Column:
    return x.isin(*values)


def regexm(s: Column, pattern: str) -> Column:
    """Whether the pattern is found; false for missing."""
    return F.coalesce(s.rlike(pattern), F.lit(False))


def regexr(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, pattern, new)


def regexs(s: Column, pattern: str, n: int) -> Column:
    """The n-th group, missing where the pattern is not found."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, n))


def substr(s: Column, start: int, n: int) -> Column:
    return F.substring(s, start, n)


def strlen(s: Column) -> Column:
    return F.char_length(s)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def word(s: Column, n: int) -> Column:
    """The n-th word, from 1; missing beyond the last."""
    return F.get(F.split(trim(s), r"\s+"), F.lit(n - 1))


def strmatch(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})")


def strpos(s: Column, find: str) -> Column:
    return F.instr(s, find)


def subinstr(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def real(s: Column) -> Column:
    return s.try_cast("double")


def string(x: Column) -> Column:
    return x.cast("string")


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def round_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor."""
    return a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def min2(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def max2(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def cond(c: Column, a, b) -> Column:
    return F.when(c, a).otherwise(b)


def concat(*parts: Column) -> Column:
    return F.concat(*(p.cast("string") for p in parts))
