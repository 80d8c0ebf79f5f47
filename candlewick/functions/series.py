"""Columns computed by numpy on one symbol's series at a time: the rows of a key come to a task sorted by time, stretches of a window at once.

For figures whose moving frames SQL would add up again at every row. One key's series must fit a task, as calendar bars do; longer ones are cut first,
see `functions.segments`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from candlewick.functions.windows import over

#: Windows that are laid out at once.
ROWS = 4096
Figures = Callable[[np.ndarray], dict[str, np.ndarray]]


def on_series(df: DataFrame, value: str, figures: Figures, out: tuple[str, ...]) -> DataFrame:
    """df with the double columns `out`: `figures` of the values of each key in order of time, NULL and NaN being the same."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        made = figures(table.column(value).to_numpy().astype(np.float64))
        for name in out:
            table = table.append_column(name, pa.array(made[name], pa.float64(), from_pandas=True))
        return table

    s = over(df)
    order = s.order
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in out)])
    return df.groupBy(*s.by).applyInArrow(run, schema)


def rolling(x: np.ndarray, n: int, figure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """`figure` of every whole window of n values without NaN, NaN elsewhere; it gets each window's mean and its deviations from that.

    Deviations are taken from the window's first value first, so that equal values have none at all.
    """
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, n)
    for low in range(0, len(windows), ROWS):
        w = windows[low:low + ROWS]
        apart = w - w[:, :1]
        mean = apart.mean(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[low + n - 1:low + n - 1 + len(w)] = figure(w[:, 0] + mean[:, 0], apart - mean)
    return out


def sample_std(d: np.ndarray) -> np.ndarray:
    """Sample deviation of windows from their deviations."""
    return np.sqrt(np.einsum("ij,ij->i", d, d) / (d.shape[1] - 1))
