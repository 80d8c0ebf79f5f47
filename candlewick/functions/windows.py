"""Rolling expressions over a time series, all sharing one sort.

`over(df)` builds the helper for a frame keyed by symbol (or other columns). If the frame carries the segment column
of `functions.segments`, it joins the partition key, so the same operator code runs on split long series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.guards import Num, adjusted_kurt, adjusted_skew, col

SEGMENT = "_segment"


class Rolling:
    def __init__(self, by: list[str], order: list[str]):
        self.by, self.order = by, order
        self.w = Window.partitionBy(*by).orderBy(*order)
        self.desc = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
        self.all = Window.partitionBy(*by)
        self.running = self.w.rowsBetween(Window.unboundedPreceding, 0)

    def frame(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def lag(self, x: Num, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.w)

    def diff(self, x: Num, n: int = 1) -> Column:
        return col(x) - self.lag(x, n)

    def change(self, x: Num, n: int = 1) -> Column:
        """x / x[n rows ago] - 1"""
        return F.try_divide(col(x), self.lag(x, n)) - 1

    def full(self, agg: Callable[[Column], Column], x: Num, n: int) -> Column:
        """Aggregate over the last n rows; NULL until n non-null values are in the frame."""
        f = self.frame(n)
        return F.when(F.count(col(x)).over(f) == n, agg(col(x)).over(f))

    def mean(self, x: Num, n: int) -> Column:
        return self.full(F.avg, x, n)

    def std(self, x: Num, n: int) -> Column:
        return self.full(F.stddev_samp, x, n)

    def total(self, x: Num, n: int) -> Column:
        return self.full(F.sum, x, n)

    def low(self, x: Num, n: int) -> Column:
        return self.full(F.min, x, n)

    def high(self, x: Num, n: int) -> Column:
        return self.full(F.max, x, n)

    def quantile(self, x: Num, q: float, n: int) -> Column:
        return self.full(lambda c: F.percentile(c, F.lit(q)), x, n)

    def skew(self, x: Num, n: int) -> Column:
        return adjusted_skew(self.full(F.skewness, x, n), F.lit(float(n)))

    def kurt(self, x: Num, n: int) -> Column:
        return adjusted_kurt(self.full(F.kurtosis, x, n), F.lit(float(n)))

    def from_last(self) -> Column:
        """1 for the newest row, 2 for the one before, ..."""
        return F.row_number().over(self.desc)

    def newest(self, n: int) -> Column:
        """True on the newest n rows; unlike `from_last` it takes no second sort."""
        return F.lead(F.lit(1), n).over(self.w).isNull()

    def position(self) -> Column:
        """1 for the oldest row."""
        return F.row_number().over(self.w)


def over(df: DataFrame, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> Rolling:
    keys = [*by, SEGMENT] if SEGMENT in df.columns else list(by)
    return Rolling(keys, list(order))
