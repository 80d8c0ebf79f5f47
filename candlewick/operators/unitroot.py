"""Unit-root and cointegration tests. Spark packs, shuffles and pairs the series; a task runs the small regressions.

A series is reduced to one close per calendar day before packing, so a packed array is bounded by the calendar, and pairs
are formed block against block: a task holds two blocks of symbols, never the whole universe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.blocks import block_count, spread, to_block_pairs
from candlewick.functions.tables import stored

# fixed values: MacKinnon (1994) response surface, constant case, for 1 and 2 series:
# turning point, bounds, lower-branch and upper-branch polynomial
MACKINNON = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
# fixed values: MacKinnon (2010) 5 % critical value, constant case, one series, in powers of 1/n
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)


def p_value(tau: float, series: int = 1) -> float:
    turn, low, high, lower, upper = MACKINNON[series]
    if tau > high:
        return 1.0
    if tau < low:
        return 0.0
    z = sum(c * tau ** k for k, c in enumerate(lower if tau <= turn else upper))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def critical_5(n: int) -> float:
    return sum(c / n ** k for k, c in enumerate(CRITICAL_5))


def _design(x: np.ndarray, dx: np.ndarray, lags: int, constant: bool) -> tuple[np.ndarray, np.ndarray]:
    rows = len(dx) - lags
    base = [x[lags:lags + rows]] + ([np.ones(rows)] if constant else [])
    return np.column_stack(base + [dx[lags - k:lags - k + rows] for k in range(1, lags + 1)]), dx[lags:]


def adf(x: np.ndarray, constant: bool = True) -> tuple[float, int, int]:
    """(t statistic, lags chosen by AIC, rows used). One QR gives the fit of every nested lag order."""
    x = np.asarray(x, dtype=float)
    trend = int(constant)
    longest = min(math.ceil(12.0 * (len(x) / 100.0) ** 0.25), len(x) // 2 - trend - 1)
    if longest < 0 or np.ptp(x) == 0:
        return math.nan, 0, 0
    dx = np.diff(x)
    wide, y = _design(x, dx, longest, constant)
    q, _ = np.linalg.qr(wide)
    rest = y @ y - np.cumsum((q.T @ y) ** 2)
    k = np.arange(1, wide.shape[1] + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        aic = len(y) * np.log(np.maximum(rest, 1e-300) / len(y)) + 2 * k
    lags = int(np.argmin(aic[trend:]))
    design, y = _design(x, dx, lags, constant)
    inverse = np.linalg.pinv(design.T @ design)
    coef = inverse @ (design.T @ y)
    free = len(y) - design.shape[1]
    if free <= 0:
        return math.nan, lags, len(y)
    s2 = float(np.sum((y - design @ coef) ** 2)) / free
    scale = math.sqrt(max(s2 * inverse[0, 0], 0.0))
    return (float(coef[0]) / scale if scale > 0 else math.nan), lags, len(y)


def engle_granger(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Statistic and p-value of the residual test with a constant in the first step."""
    design = np.column_stack([x, np.ones(len(x))])
    coef, *_ = np.linalg.lstsq(design, y, rcond=None)
    stat, _, _ = adf(y - design @ coef, constant=False)
    return stat, (p_value(stat, 2) if stat == stat else math.nan)


def through_origin(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Slope without constant, and the unit-root test of its residual."""
    beta = float(x @ y) / float(x @ x)
    stat, _, _ = adf(y - beta * x)
    return beta, stat, (p_value(stat) if stat == stat else math.nan)


def packed(bars: DataFrame, price: str = "close") -> DataFrame:
    """One row per symbol: day numbers and the last price of each day (arrays no longer than the calendar)."""
    day = F.datediff("ts", F.lit("1970-01-01"))
    daily = bars.filter(F.col(price).isNotNull()).groupBy("symbol", day.alias("d")).agg(F.max_by(price, "ts").alias("p"))
    return daily.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("d", "p"))).alias("s")).select(
        "symbol", F.col("s.d").alias("t"), F.col("s.p").alias("v"))


def adf_table(bars: DataFrame, level: float = 0.1) -> DataFrame:
    """Unit-root test per symbol; `non_stationary` when p exceeds the level and the statistic its 5 % critical value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, v in zip(batch["symbol"], batch["v"]):
                stat, lags, n = adf(np.asarray(v))
                p = p_value(stat) if stat == stat else math.nan
                rows.append((name, len(v), lags, stat, p, bool(p > level and stat > critical_5(max(n, 1)))))
            yield pd.DataFrame(rows, columns=["symbol", "n", "lags", "stat", "p_value", "non_stationary"])

    return packed(bars).mapInPandas(run, "symbol string, n long, lags int, stat double, p_value double, non_stationary boolean")


def tiles(series: DataFrame) -> int:
    """A test costs far more than a product, so blocks are a quarter of those of pair moments."""
    return 4 * block_count(series)


PAIR_OUT = ("asset_i string, asset_j string, n long, beta double, resid_stat double, resid_p double, "
            "coint_stat double, coint_p double")


def pair_tests(bars: DataFrame, ordered: bool = False, min_rows: int = 90, blocks: int | None = None, residual: bool = True,
               coint: bool = True) -> DataFrame:
    """Residual test of asset_j on asset_i without constant, and Engle-Granger of asset_i on asset_j, for all pairs."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bi, bj = frame["_bi"].iat[0], frame["_bj"].iat[0]
        rows = []
        items = list(zip(frame["_b"], frame["symbol"], frame["t"], frame["v"]))
        left = [i for i in items if i[0] == bi]
        right = [i for i in items if i[0] == bj]
        for _, a, ta, va in left:
            for _, b, tb, vb in right:
                if a == b or (bi == bj and a > b):
                    continue
                first, second = ((a, ta, va), (b, tb, vb)) if a < b else ((b, tb, vb), (a, ta, va))
                _, at, bt = np.intersect1d(first[1], second[1], assume_unique=True, return_indices=True)
                x, y = np.asarray(first[2])[at], np.asarray(second[2])[bt]
                if len(x) <= min_rows:
                    continue
                for (n1, u), (n2, w) in ([((first[0], x), (second[0], y)), ((second[0], y), (first[0], x))] if ordered
                                         else [((first[0], x), (second[0], y))]):
                    r = through_origin(w, u) if residual else (math.nan,) * 3
                    c = engle_granger(u, w) if coint else (math.nan,) * 2
                    rows.append((n1, n2, len(u), *r, *c))
        names = ["asset_i", "asset_j", "n", "beta", "resid_stat", "resid_p", "coint_stat", "coint_p"]
        return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame()

    series = stored(packed(bars), "packed-series")
    blocks = blocks or tiles(series)
    return spread(to_block_pairs(series, blocks), blocks, "_bi", "_bj").groupBy("_bi", "_bj").applyInPandas(run, PAIR_OUT)


def coint_scan(bars: DataFrame, level: float = 0.05, min_rows: int = 90, blocks: int | None = None) -> DataFrame:
    """Engle-Granger statistic and p-value of every ordered pair with more than `min_rows` common rows."""
    return pair_tests(bars, True, min_rows, blocks, residual=False).select(
        "asset_i", "asset_j", "n", "coint_stat", "coint_p", (F.col("coint_p") < level).alias("cointegrated"))
