"""All indicator families at once by numpy, for the wide table: the same figures as the single operators of `indicators`, in one pass over sorted rows."""

from __future__ import annotations

import numpy as np

from candlewick.functions.decay import alpha_of
from candlewick.functions.moving import Stretch, divided
from candlewick.functions.rounding import half_up, tidied

INPUTS = ("high", "low", "close", "volume")
FIGURES = ("sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "ema_50", "macd", "macd_signal", "macd_histogram", "true_range", "atr_14",
           "plus_di", "minus_di", "dx", "adx", "keltner_upper", "keltner_lower", "rsi", "stoch_k", "stoch_d", "williams_r", "roc_10", "roc_30",
           "volume_roc", "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position", "vol_30", "vol_60", "vol_90", "vol_180", "vwap_20",
           "obv", "ad_line", "volume_sma_20", "volume_ratio")
FLAGS = ("above_sma_20", "ema_up", "macd_up", "rsi_oversold", "rsi_overbought", "stoch_oversold", "stoch_overbought", "bb_squeeze", "bb_breakout",
         "bb_breakdown", "volume_spike", "above_volume_sma")
YEAR = 252.0 ** 0.5


def figures(s: Stretch, only: tuple[str, ...], digits: int | None) -> dict[str, np.ndarray]:
    """The columns `only`, doubles tidied to so many digits if given."""
    with np.errstate(all="ignore"):
        f = {**_trend(s), **_range(s), **_momentum(s), **_volatility(s), **_volume(s)}
        f |= {"keltner_upper": f["ema_12"] + 2.0 * f["atr_14"], "keltner_lower": f["ema_12"] - 2.0 * f["atr_14"]}
        flags = _flags(s, f)
    return {c: flags[c] if c in flags else f[c] if digits is None else tidied(f[c], digits) for c in only}


def _trend(s: Stretch) -> dict[str, np.ndarray]:
    c = s["close"]
    f = {f"sma_{n}": s.mean(c, n) for n in (20, 50, 200)} | {f"ema_{n}": s.decayed(c, alpha_of(span=n)) for n in (12, 26, 50)}
    f["macd"] = f["ema_12"] - f["ema_26"]
    f["macd_signal"] = s.decayed(f["macd"], alpha_of(span=9))
    return f | {"macd_histogram": f["macd"] - f["macd_signal"]}


def _range(s: Stretch) -> dict[str, np.ndarray]:
    h, low, before = s["high"], s["low"], s.lag(s["close"])
    # the largest of those that are there
    span = np.fmax(np.fmax(h - low, np.abs(h - before)), np.abs(low - before))
    tr = np.where(np.isnan(before), np.nan, span)
    up, down = h - s.lag(h), s.lag(low) - low
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    atr = s.mean(tr, 14)
    f = {"true_range": tr, "atr_14": atr, "plus_di": 100 * divided(s.mean(plus, 14), atr), "minus_di": 100 * divided(s.mean(minus, 14), atr)}
    f["dx"] = 100 * divided(np.abs(f["plus_di"] - f["minus_di"]), f["plus_di"] + f["minus_di"])
    return f | {"adx": s.mean(f["dx"], 14)}


def _momentum(s: Stretch) -> dict[str, np.ndarray]:
    c, v = s["close"], s["volume"]
    d = c - s.lag(c)
    gain, loss = s.mean(np.fmax(d, 0.0), 14), s.mean(np.fmax(-d, 0.0), 14)
    rsi = np.where(loss == 0, np.where(gain > 0, 100.0, np.nan), 100 - 100 / (1 + divided(gain, loss)))
    low, high = s.low(s["low"], 14), s.high(s["high"], 14)
    k = 100 * divided(c - low, high - low)
    return {"rsi": rsi, "stoch_k": k, "stoch_d": s.mean(k, 3), "williams_r": -100 * divided(high - c, high - low),
            "roc_10": 100 * s.change(c, 10), "roc_30": 100 * s.change(c, 30), "volume_roc": 100 * s.change(v, 5)}


def _volatility(s: Stretch) -> dict[str, np.ndarray]:
    c = s["close"]
    middle, sd = s.mean(c, 20), s.stds(c, (20,))[20]
    upper, lower = middle + 2.0 * sd, middle - 2.0 * sd
    width = upper - lower
    f = {"bb_middle": middle, "bb_upper": upper, "bb_lower": lower, "bb_width": divided(width, middle), "bb_position": divided(c - lower, width)}
    return f | {f"vol_{n}": sd * YEAR for n, sd in s.stds(s.change(c), (30, 60, 90, 180)).items()}


def _volume(s: Stretch) -> dict[str, np.ndarray]:
    h, low, c, v = (s[x] for x in INPUTS)
    d = c - s.lag(c)
    flow = divided(2 * c - low - h, h - low) * v
    mean = s.mean(v, 20)
    return {"vwap_20": divided(s.total((h + low + c) / 3 * v, 20), s.total(v, 20)),
            "obv": s.running(np.where(np.isnan(d), v, np.sign(d) * v)),
            "ad_line": np.where(np.isnan(flow), np.nan, s.running(flow)),
            "volume_sma_20": mean, "volume_ratio": divided(v, mean)}


def _flags(s: Stretch, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """1 where the condition holds, 0 where it is false or unknown."""
    c, k, d = s["close"], f["stoch_k"], f["stoch_d"]
    held = {"above_sma_20": c > f["sma_20"], "ema_up": f["ema_12"] > f["ema_26"], "macd_up": f["macd"] > f["macd_signal"],
            "rsi_oversold": f["rsi"] < 30, "rsi_overbought": f["rsi"] > 70, "stoch_oversold": (k < 20) & (d < 20),
            "stoch_overbought": (k > 80) & (d > 80), "bb_squeeze": half_up(f["bb_width"], 12) < half_up(s.quantile(f["bb_width"], 0.2, 20), 12),
            "bb_breakout": c > f["bb_upper"], "bb_breakdown": c < f["bb_lower"], "volume_spike": f["volume_ratio"] > 2,
            "above_volume_sma": s["volume"] > f["volume_sma_20"]}
    return {name: x.astype(np.int32) for name, x in held.items()}
