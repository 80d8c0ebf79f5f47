"""Mean-variance weights inside a box and a turnover cap: projected gradient steps, each projection by bisection.

The nearest point to v that sums to one, stays in [low, high] and within an L1 distance of the old weights has the form
clip(old + soft(v - shift - old, toll), low, high): the shift is found by bisection on the sum, the toll by bisection and chords on the turnover. Spark pairs each
universe and date with its matrix and deals them to tasks; a matrix is that of one investable list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.operators.views import _whole

#: Assets of one universe, at most.
LARGEST = 4000
OUT = "universe string, day timestamp_ntz, symbol string, old double, weight double, turnover double, objective double, feasible boolean"


def _with_sum(v: np.ndarray, old: np.ndarray, low: np.ndarray, high: np.ndarray, toll: float) -> np.ndarray:
    """clip(old + soft(v - shift - old, toll)) with the shift that makes it sum to 1.

    The sum falls with the shift in straight pieces, so the bisection runs over the bends and ends inside one piece.
    """
    g = v - old

    def point(shift: float) -> np.ndarray:
        d = g - shift
        return np.clip(old + np.sign(d) * np.maximum(np.abs(d) - toll, 0), low, high)

    bends = np.sort(np.concatenate([g + side * toll - edge for side in (-1, 1) for edge in (np.zeros_like(g), high - old, low - old)]))
    a, b = 0, len(bends) - 1
    while b - a > 1:
        middle = (a + b) // 2
        a, b = (middle, b) if point(bends[middle]).sum() > 1 else (a, middle)
    above, below = point(bends[a]).sum(), point(bends[b]).sum()
    share = (above - 1) / (above - below) if above > below else 0.0
    return point(bends[a] + min(max(share, 0.0), 1.0) * (bends[b] - bends[a]))


def project(v: np.ndarray, old: np.ndarray, low: np.ndarray, high: np.ndarray, turnover: float) -> np.ndarray:
    """The nearest allowed point. Some point must be allowed."""
    w = _with_sum(v, old, low, high, 0.0)
    over = np.abs(w - old).sum() - turnover
    if over <= 0:
        return w
    # the turnover falls with the toll in straight pieces too: a chord where it does well, else the middle
    a, b, w = 0.0, 4 * float(np.abs(v).max() + np.abs(old).max() + 1), None
    under = np.abs((w := _with_sum(v, old, low, high, b)) - old).sum() - turnover
    for k in range(100):
        if under > -1e-13 or b - a < 1e-15 * b:
            break
        toll = a + (b - a) * over / (over - under) if k % 3 else (a + b) / 2
        new = _with_sum(v, old, low, high, toll)
        gap = np.abs(new - old).sum() - turnover
        if gap > 0:
            a, over = toll, gap
        else:
            b, under, w = toll, gap, new
    return w


def nearest_turnover(old: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The least turnover that leads into the box with a sum of 1; infinite where none does."""
    if low.sum() > 1 + 1e-12 or high.sum() < 1 - 1e-12 or (low > high).any():
        return np.inf
    inside = np.clip(old, low, high)
    return float(np.abs(inside - old).sum() + abs(1 - inside.sum()))


def improve(mu: np.ndarray, cov: np.ndarray, aversion: float, old: np.ndarray, low: np.ndarray, high: np.ndarray, turnover: float, steps: int = 400) -> np.ndarray:
    """Weights with the largest mu'w - aversion / 2 w'Cw by accelerated projected gradients."""
    scale = aversion * np.linalg.norm(cov, 2)
    if scale <= 0:
        scale = max(float(np.abs(mu).max()), 1e-12)
    w = ahead = project(old, old, low, high, turnover)
    pace = 1.0
    for _ in range(steps):
        new = project(ahead + (mu - aversion * (cov @ ahead)) / scale, old, low, high, turnover)
        if (ahead - new) @ (new - w) > 0:
            # the momentum points back: start it again
            pace, ahead = 1.0, w
            new = project(ahead + (mu - aversion * (cov @ ahead)) / scale, old, low, high, turnover)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, gone = new + (pace - 1) / faster * (new - w), np.abs(new - w).max()
        w, pace = new, faster
        if gone < 1e-10:
            break
    return w


def bounded_weights(old: DataFrame, mu: DataFrame, cov: DataFrame, low: float = 0.0, high: float = 0.05, turnover: float = 0.2, aversion: float = 2.5) -> DataFrame:
    """For each (universe, day) of old (universe, day, symbol, weight) the weights of the largest mean less aversion / 2 variance that sum to 1, lie in the box and
    are within `turnover`, the sum of absolute changes, of the old ones.

    mu: (universe, symbol, mu); cov: half-stored (universe, asset_i, asset_j, cov), a missing pair is 0. Where no weights are allowed the old ones
    stay, with feasible false. An asset without mu counts with 0. A universe of over LARGEST assets is an error.
    """
    # one row per asset: its own row of the matrix, so that a universe's rows are n and hold n entries each
    lines = _whole(cov).groupBy("universe", F.col("asset_i").alias("symbol")).agg(F.collect_list(F.struct("asset_j", "cov")).alias("line"))
    rows = old.select("universe", "day", "symbol", F.col("weight").alias("old")).join(mu.select("universe", "symbol", "mu"), ["universe", "symbol"], "left").join(
        lines, ["universe", "symbol"], "left").select("universe", "day", "symbol", "old", F.coalesce("mu", F.lit(0.0)).alias("mu"), F.col("line.asset_j").alias("others"), F.col("line.cov").alias("line"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("symbol").reset_index(drop=True)
        n = len(frame)
        if n > LARGEST:
            raise ValueError(f"a universe of {n} assets, {LARGEST} at most")
        at, c = {s: k for k, s in enumerate(frame["symbol"])}, np.zeros((n, n))
        for k, (others, line) in enumerate(zip(frame["others"], frame["line"], strict=True)):
            for name, value in zip(others if others is not None else (), line if line is not None else (), strict=True):
                if name in at:
                    c[k, at[name]] = value
        before, m, lo, hi = frame["old"].to_numpy(float), frame["mu"].to_numpy(float), np.full(n, low), np.full(n, high)
        allowed = nearest_turnover(before, lo, hi) <= turnover + 1e-12
        w = improve(m, c, aversion, before, lo, hi, turnover) if allowed else before
        return pd.DataFrame({"universe": frame["universe"], "day": frame["day"], "symbol": frame["symbol"], "old": before, "weight": w,
                             "turnover": np.abs(w - before).sum(), "objective": m @ w - aversion / 2 * w @ c @ w, "feasible": bool(allowed)})

    return rows.groupBy("universe", "day").applyInPandas(work, OUT)
