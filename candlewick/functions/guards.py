"""Arithmetic that yields NULL where floating point would give inf or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | str | float | int


def col(x: Num) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def div(a: Num, b: Num) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(col(a), col(b))


def ln(x: Num) -> Column:
    """Natural log, NULL at or below zero."""
    return F.when(col(x) > 0, F.log(col(x)))


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(x: Num, lo: float, hi: float) -> Column:
    """Bound to [lo, hi], keeping NULL."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))


def clean_nan(x: Num) -> Column:
    """NaN to NULL."""
    return F.nanvl(col(x), F.lit(None).cast("double"))


def tidy(x: Num, digits: int = 6) -> Column:
    """Round for presentation. The nudge moves exact decimal ties, which engines round in different directions."""
    return F.round(col(x) + F.lit(10.0 ** -(digits + 3)), digits)


def rounded(df, digits: int = 6, keep: tuple[str, ...] = ()):
    """Tidy every double column except those in `keep`."""
    return df.select(*[
        tidy(name, digits).alias(name) if kind == "double" and name not in keep else F.col(name)
        for name, kind in df.dtypes
    ])


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Sample skewness from the population one (needs 3 values)."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurt(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population one (needs 4 values)."""
    return F.when(n > 3, div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
