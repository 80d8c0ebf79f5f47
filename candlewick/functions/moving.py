"""Moving figures by numpy over many whole series at once: the rows of a key come to a task together and in order of time, and one call gets a stretch of
rows with as many whole series as arrived.

Every step is one operation on the stretch, whatever the number of series in it. Missing is NaN inside, NULL outside; it spreads through sums and
extremes, which is the full-window rule. One key's series must fit a task, as calendar bars do; longer ones are cut first, see `functions.segments`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.windows import over

#: Rows handed back to Spark at once, at most.
ROWS = 10_000
AT = "_at"
#: Where the double columns of a stretch begin new series (place of each row in its series) to what is made of them.
Made = Callable[["Stretch"], dict[str, np.ndarray]]


def on_stretches(df: DataFrame, values: tuple[str, ...], made: Made, doubles: tuple[str, ...], ints: tuple[str, ...] = (), keep: tuple[str, ...] | None = None) -> DataFrame:
    """df, or its columns `keep`, with the columns `doubles` and `ints` that `made` makes of the columns `values`, which must be numbers."""
    own = [c for c in keep or df.columns if c not in (*doubles, *ints)]
    sent = {c: c if c in own and dict(df.dtypes)[c] == "double" else f"_v_{c}" for c in values}
    # numbered first: what is made of the columns need not be shuffled
    placed = df.withColumn(AT, over(df).position()).select(
        *own, AT, *[F.col(c).cast("double").alias(name) for c, name in sent.items() if name not in own])
    schema = T.StructType([*df.select(*own).schema.fields, *(T.StructField(c, T.DoubleType()) for c in doubles),
                           *(T.StructField(c, T.IntegerType(), False) for c in ints)])

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = table.column(AT).to_numpy()
        new = made(Stretch(at - 1, {c: table.column(name).to_numpy().astype(np.float64) for c, name in sent.items()}))
        out = table.select(own)
        for c in doubles:
            out = out.append_column(c, pa.array(new[c], pa.float64(), from_pandas=True))
        for c in ints:
            out = out.append_column(c, pa.array(new[c], pa.int32()))
        yield from out.to_batches(max_chunksize=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last series, which the next batch may go on with
        for batch in batches:
            starts = np.flatnonzero(batch.column(AT).to_numpy() == 1)
            if len(starts):
                whole = [*held, batch.slice(0, starts[-1])]
                held = []
                if sum(b.num_rows for b in whole):
                    yield from finished(pa.Table.from_batches(whole).combine_chunks())
                batch = batch.slice(starts[-1])
            held.append(batch)
        if sum(b.num_rows for b in held):
            yield from finished(pa.Table.from_batches(held).combine_chunks())

    return placed.mapInArrow(run, schema)


class Stretch:
    """Columns of whole series, one after the other; `at` is the zero-based place of each row in its series."""

    def __init__(self, at: np.ndarray, columns: dict[str, np.ndarray]):
        self.at, self.columns = at, columns

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def known(self, x: np.ndarray, n: int) -> np.ndarray:
        """x where n rows of the series lie before the row, NaN elsewhere."""
        return np.where(self.at >= n, x, np.nan)

    def lag(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return self.known(_back(x, n), n)

    def change(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return divided(x, self.lag(x, n)) - 1

    def total(self, x: np.ndarray, n: int) -> np.ndarray:
        """Sum of the last n rows, added from the oldest on."""
        out = _back(x, n - 1).copy()
        for k in range(n - 2, 0, -1):
            out[k:] += x[:-k]
        return self.known(out + x if n > 1 else out, n - 1)

    def mean(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.total(x, n) / n

    def low(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._extreme(np.minimum, x, n)

    def high(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._extreme(np.maximum, x, n)

    def _extreme(self, of: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
        m, best = 1, x
        while 2 * m <= n:
            best, m = of(best, _back(best, m)), 2 * m
        return self.known(of(best, _back(best, n - m)), n - 1)

    def stds(self, x: np.ndarray, windows: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Sample deviations of the last n rows for several n: means and squares of windows of 1, 2, 4, ... rows, put together for each n; equal values have none at all."""
        kept = {n: None for n in windows}
        m, mean, square = 1, x, np.zeros(len(x))
        while m <= max(windows):
            for n in windows:
                if n & m:
                    # rows nearer than this piece are already in; it comes before them
                    kept[n] = (m, mean, square) if kept[n] is None else _joined(_before((m, mean, square), kept[n][0]), kept[n])
            _, mean, square = _joined(_before((m, mean, square), m), (m, mean, square))
            m *= 2
        return {n: self.known(np.sqrt(kept[n][2] / (n - 1)), n - 1) for n in windows}

    def decayed(self, x: np.ndarray, alpha: float) -> np.ndarray:
        """`functions.decay.ewm_means` of a column, step by step."""
        there = np.flatnonzero(~np.isnan(x))
        # place of each value among those of its series
        before = np.cumsum(~np.isnan(x)) - 1
        first = np.flatnonzero(self.at == 0)
        at = np.arange(len(there)) - np.repeat((before - ~np.isnan(x) + 1)[first], np.diff([*first, len(x)]))[there]
        g = 1.0 - alpha
        s, m, power, reach = x[there], 1, g, math.ceil(-37.0 / math.log(g))
        while m < reach:
            s, m, power = s + power * np.where(at >= m, _back(s, m), 0.0), 2 * m, power * power
        out = np.full(len(x), np.nan)
        out[there] = s / ((1.0 - np.power(g, at + 1.0)) / (1.0 - g))
        return out

    def running(self, x: np.ndarray) -> np.ndarray:
        """Sum of the values so far, NaN before the first."""
        there = ~np.isnan(x)
        parts = np.split(np.where(there, x, 0.0), np.flatnonzero(self.at == 0)[1:])
        seen = np.concatenate([np.logical_or.accumulate(p) for p in np.split(there, np.flatnonzero(self.at == 0)[1:])])
        return np.where(seen, np.concatenate([np.add.accumulate(p) for p in parts]), np.nan)

    def quantile(self, x: np.ndarray, q: float, n: int) -> np.ndarray:
        """Interpolated q-quantile of the last n rows."""
        out = np.full(len(x), np.nan)
        low, part = int((n - 1) * q), (n - 1) * q - int((n - 1) * q)
        if len(x) >= n:
            seen = np.sort(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
            out[n - 1:] = np.where(np.isnan(seen[:, -1]), np.nan, seen[:, low] + part * (seen[:, min(low + 1, n - 1)] - seen[:, low]))
        return self.known(out, n - 1)


def _back(x: np.ndarray, n: int) -> np.ndarray:
    """x n rows ago, in whatever series that is; NaN before the first row."""
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[:max(len(x) - n, 0)]]) if n else x


Moments = tuple[int, np.ndarray, np.ndarray]


def _before(piece: Moments, n: int) -> Moments:
    return piece[0], _back(piece[1], n), _back(piece[2], n)


def _joined(a: Moments, b: Moments) -> Moments:
    """Rows, mean and squared deviations of two pieces together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN when b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)
