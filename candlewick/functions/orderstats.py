"""Quantiles of all values so far, from two heaps: those up to the wanted rank and those above it.

A row costs a few heap steps, the logarithm of the values seen. A symbol's whole series comes to one task, so it must fit there, as calendar bars do.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame

from candlewick.functions.series import on_series


def quantiles_so_far(values: np.ndarray, q: float) -> np.ndarray:
    """The interpolated q-quantile of the values up to each place, NaN being skipped; NaN before the first."""
    out = np.full(len(values), np.nan)
    low: list[float] = []  # negated: the largest first
    high: list[float] = []
    last = math.nan
    for i, x in enumerate(values.tolist()):
        if x == x:
            if low and x < -low[0]:
                heapq.heappush(low, -x)
            else:
                heapq.heappush(high, x)
            place = (len(low) + len(high) - 1) * q
            rank = math.floor(place)
            while len(low) <= rank:
                heapq.heappush(low, -heapq.heappop(high))
            while len(low) > rank + 1:
                heapq.heappush(high, -heapq.heappop(low))
            part = place - rank
            last = -low[0] * (1 - part) + high[0] * part if part > 0 else -low[0]
        out[i] = last
    return out


def expanding_quantile(df: DataFrame, value: str, out: str, q: float = 0.5) -> DataFrame:
    """df (symbol, ts, value, ...) with `out`: the interpolated q-quantile of the symbol's non-null values up to the row; null before the first. (symbol, ts) must not repeat."""
    return on_series(df, value, lambda x: {out: quantiles_so_far(x, q)}, (out,))
