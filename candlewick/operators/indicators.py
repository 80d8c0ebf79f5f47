"""Technical indicators. Input: bars keyed (symbol, ts); output: the bars plus the named columns.

All rolling columns share one (symbol, ts) sort and obey the full-window rule: NULL until the window holds n values.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.decay import alpha_of, ewm_mean, ewm_means
from candlewick.functions.guards import div, flag
from candlewick.functions.moving import on_stretches
from candlewick.functions.windows import over
from candlewick.operators import wide
from candlewick.schemas import require_columns

PRICE = ["symbol", "ts", "close"]
ANNUAL = 252.0
SUMMARY = ("sma_20", "ema_12", "macd", "macd_signal", "adx", "rsi", "stoch_k", "williams_r", "bb_position", "bb_width", "atr_14", "vol_30",
           "volume_ratio", "obv")


def sma(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    s = over(require_columns(bars, PRICE))
    return bars.withColumns({f"sma_{n}": s.mean("close", n) for n in windows})


def ema(bars: DataFrame, spans: tuple[int, ...] = (12, 26, 50)) -> DataFrame:
    return ewm_means(bars, {f"ema_{n}": ("close", alpha_of(span=n)) for n in spans}) if spans else bars


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    need = tuple(n for n in (fast, slow) if f"ema_{n}" not in bars.columns)
    out = ema(bars, need).withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    out = ewm_mean(out, "macd", "macd_signal", span=signal)
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop(*[f"ema_{n}" for n in need])


def true_range(bars: DataFrame, first_row: str = "null") -> DataFrame:
    """Largest of high-low and the gaps to the previous close; `first_row='range'` keeps high-low on row one."""
    prev = over(bars).lag("close")
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return bars.withColumn("true_range", span if first_row == "range" else F.when(prev.isNotNull(), span))


def atr(bars: DataFrame, n: int = 14, first_row: str = "null") -> DataFrame:
    out = true_range(bars, first_row)
    return out.withColumn(f"atr_{n}", over(out).mean("true_range", n))


def atr_ewm(bars: DataFrame, com: int = 14) -> DataFrame:
    prices = ("open", "high", "low", "close")
    out = bars.withColumn("price_range", F.greatest(*prices) - F.least(*prices))
    return ewm_mean(out, "price_range", "atr_ewm", com=com)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional index; the first bar counts as zero movement while its true range is unknown."""
    s = over(bars)
    up, down = s.diff("high"), s.lag("low") - F.col("low")
    out = true_range(bars).withColumns({
        "_up": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_down": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    out = out.withColumns({"_tr": s.mean("true_range", n), "_pu": s.mean("_up", n), "_pd": s.mean("_down", n)})
    out = out.withColumns({"plus_di": 100 * div("_pu", "_tr"), "minus_di": 100 * div("_pd", "_tr")})
    out = out.withColumn("dx", 100 * div(F.abs(F.col("plus_di") - F.col("minus_di")),
                                         F.col("plus_di") + F.col("minus_di")))
    return out.withColumn("adx", s.mean("dx", n)).drop("_up", "_down", "_tr", "_pu", "_pd")


def _gain_loss(bars: DataFrame, n: int, first: float | None) -> DataFrame:
    s = over(bars)
    d = s.diff("close")
    moved = bars.withColumns({
        "_gain": F.when(d.isNull(), F.lit(first)).otherwise(F.greatest(d, F.lit(0.0))),
        "_loss": F.when(d.isNull(), F.lit(first)).otherwise(F.greatest(-d, F.lit(0.0)))})
    return moved.withColumns({"_gain": s.mean("_gain", n), "_loss": s.mean("_loss", n)})


def _rsi(bars: DataFrame, n: int, out: str, first: float | None, no_loss: Column, eps: float = 0.0) -> DataFrame:
    ratio = div("_gain", F.col("_loss") + eps)
    value = F.when(F.col("_loss") + eps == 0, no_loss).otherwise(100 - 100 / (1 + ratio))
    return _gain_loss(bars, n, first).withColumn(out, value).drop("_gain", "_loss")


def rsi(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """The first change counts as 0; without losses 100, without any change NULL."""
    return _rsi(bars, n, out, 0.0, F.when(F.col("_gain") > 0, 100.0))


def rsi_strict(bars: DataFrame, n: int = 14, out: str = "rsi_strict") -> DataFrame:
    """The first change is unknown; without losses NULL."""
    return _rsi(bars, n, out, None, F.lit(None).cast("double"))


def rsi_eps(bars: DataFrame, n: int = 14, out: str = "rsi_eps") -> DataFrame:
    """Loss is padded by 1e-12."""
    return _rsi(bars, n, out, 0.0, F.lit(None).cast("double"), 1e-12)


def rsi_inf(bars: DataFrame, n: int = 14, out: str = "rsi_inf") -> DataFrame:
    """A zero loss counts as infinite, so the index falls to 0."""
    return _rsi(bars, n, out, 0.0, F.lit(0.0))


def rsi_momentum(bars: DataFrame, n: int = 14) -> DataFrame:
    """Share of decayed upward n-bar moves, 0..1."""
    d = over(bars).diff("close", n)
    out = bars.withColumns({"_up": F.greatest(d, F.lit(0.0)) + d * 0, "_down": F.greatest(-d, F.lit(0.0)) + d * 0})
    out = ewm_means(out, {"_eu": ("_up", alpha_of(com=n)), "_ed": ("_down", alpha_of(com=n))})
    return out.withColumn("rsi_momentum", div("_eu", F.col("_eu") + F.col("_ed"))).drop("_up", "_down", "_eu", "_ed")


def stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    s = over(bars)
    low, high = s.low("low", n), s.high("high", n)
    out = bars.withColumn("stoch_k", 100 * div(F.col("close") - low, high - low))
    return out.withColumn("stoch_d", s.mean("stoch_k", d))


def williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    s = over(bars)
    low, high = s.low("low", n), s.high("high", n)
    return bars.withColumn("williams_r", -100 * div(high - F.col("close"), high - low))


def roc(bars: DataFrame, windows: tuple[int, ...] = (10, 30)) -> DataFrame:
    s = over(bars)
    return bars.withColumns({f"roc_{n}": 100 * s.change("close", n) for n in windows})


def volume_roc(bars: DataFrame, n: int = 5) -> DataFrame:
    return bars.withColumn("volume_roc", 100 * over(bars).change("volume", n))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    s = over(bars)
    out = bars.withColumns({"bb_middle": s.mean("close", n), "_sd": s.std("close", n)})
    out = out.withColumns({"bb_upper": F.col("bb_middle") + k * F.col("_sd"),
                           "bb_lower": F.col("bb_middle") - k * F.col("_sd")}).drop("_sd")
    width = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns({"bb_width": div(width, "bb_middle"),
                            "bb_position": div(F.col("close") - F.col("bb_lower"), width)})


def vol_cone(bars: DataFrame, windows: tuple[int, ...] = (30, 60, 90, 180)) -> DataFrame:
    s = over(bars)
    out = bars.withColumn("_ret", s.change("close"))
    return out.withColumns({f"vol_{n}": s.std("_ret", n) * ANNUAL ** 0.5 for n in windows}).drop("_ret")


def keltner(bars: DataFrame, span: int = 12, n: int = 14, k: float = 2.0) -> DataFrame:
    out = bars if f"ema_{span}" in bars.columns else ema(bars, (span,))
    out = out if f"atr_{n}" in out.columns else atr(out, n)
    return out.withColumns({"keltner_upper": F.col(f"ema_{span}") + k * F.col(f"atr_{n}"),
                            "keltner_lower": F.col(f"ema_{span}") - k * F.col(f"atr_{n}")})


def vwap(bars: DataFrame, n: int = 20) -> DataFrame:
    s = over(bars)
    out = bars.withColumn("_tpv", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))
    return out.withColumn(f"vwap_{n}", div(s.total("_tpv", n), s.total("volume", n))).drop("_tpv")


def vwap_cumulative(bars: DataFrame, n: int = 20) -> DataFrame:
    """Running volume-weighted close over the newest n bars of each symbol."""
    tail = bars.withColumn("_back", over(bars).from_last()).filter(F.col("_back") <= n).drop("_back")
    s = over(tail)
    return tail.withColumn("vwap", div(F.sum(F.col("close") * F.col("volume")).over(s.running),
                                       F.sum("volume").over(s.running)))


def obv(bars: DataFrame) -> DataFrame:
    """Signed running volume, starting at the first volume."""
    s = over(bars)
    d = s.diff("close")
    moved = bars.withColumn("_flow", F.when(d.isNull(), F.col("volume")).otherwise(F.signum(d) * F.col("volume")))
    return moved.withColumn("obv", F.sum("_flow").over(s.running)).drop("_flow")


def ad_line(bars: DataFrame) -> DataFrame:
    """Running money flow; bars with high = low are left out and stay NULL."""
    s = over(bars)
    flow = div(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low")) * F.col("volume")
    out = bars.withColumn("_flow", flow)
    return out.withColumn("ad_line", F.when(F.col("_flow").isNotNull(), F.sum("_flow").over(s.running))).drop("_flow")


def volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    out = bars.withColumn(f"volume_sma_{n}", over(bars).mean("volume", n))
    return out.withColumn("volume_ratio", div("volume", f"volume_sma_{n}"))


def trend_flags(df: DataFrame) -> DataFrame:
    """Needs close, sma_20, ema_12, ema_26, macd, macd_signal."""
    return df.withColumns({"above_sma_20": flag(F.col("close") > F.col("sma_20")),
                           "ema_up": flag(F.col("ema_12") > F.col("ema_26")),
                           "macd_up": flag(F.col("macd") > F.col("macd_signal"))})


def momentum_flags(df: DataFrame) -> DataFrame:
    """Needs rsi, stoch_k, stoch_d."""
    k, d = F.col("stoch_k"), F.col("stoch_d")
    return df.withColumns({"rsi_oversold": flag(F.col("rsi") < 30), "rsi_overbought": flag(F.col("rsi") > 70),
                           "stoch_oversold": flag((k < 20) & (d < 20)),
                           "stoch_overbought": flag((k > 80) & (d > 80))})


def volatility_flags(df: DataFrame, n: int = 20, q: float = 0.2) -> DataFrame:
    """Needs the Bollinger columns."""
    # a short window is sorted as an array, which costs less than a percentile over a moving frame
    out = df.withColumn("_seen", F.array_sort(over(df).full(F.collect_list, "bb_width", n)))
    low, part = int((n - 1) * q), (n - 1) * q - int((n - 1) * q)
    out = out.withColumn("_floor", F.col("_seen")[low] + part * (F.col("_seen")[low + 1] - F.col("_seen")[low])).drop("_seen")
    return out.withColumns({"bb_squeeze": flag(F.round("bb_width", 12) < F.round("_floor", 12)),
                            "bb_breakout": flag(F.col("close") > F.col("bb_upper")),
                            "bb_breakdown": flag(F.col("close") < F.col("bb_lower"))}).drop("_floor")


def volume_flags(df: DataFrame, n: int = 20) -> DataFrame:
    """Needs the volume ratio columns."""
    return df.withColumns({"volume_spike": flag(F.col("volume_ratio") > 2),
                           "above_volume_sma": flag(F.col("volume") > F.col(f"volume_sma_{n}"))})


def momentum_state(rsi_value: Column, stoch_k: Column) -> Column:
    return F.when((rsi_value > 70) | (stoch_k > 80), "overbought").when(
        (rsi_value < 30) | (stoch_k < 20), "oversold").otherwise("neutral")


def volatility_state(width: Column, vol30: Column) -> Column:
    return F.when(width < 0.1, "low_volatility").when(vol30 > 0.8, "high_volatility").otherwise("normal_volatility")


def all_indicators(bars: DataFrame, only: tuple[str, ...] = wide.FIGURES + wide.FLAGS, digits: int | None = None,
                   keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every indicator family for every symbol in one pass over its sorted bars, or `only` some columns of them, `digits` being those of `guards.tidy`; NaN counts as NULL.

    `keep`: the columns of the bars that are wanted beside them, all if not given.
    """
    made = functools.partial(wide.figures, only=only, digits=digits)
    return on_stretches(require_columns(bars, ["symbol", "ts", *wide.INPUTS]), wide.INPUTS, made,
                        tuple(c for c in only if c in wide.FIGURES), tuple(c for c in only if c in wide.FLAGS), keep)


def indicator_summary(features: DataFrame) -> DataFrame:
    """Newest row per symbol with the state of each family. Aggregates instead of sorting."""
    last = features.groupBy("symbol").agg(F.max_by(F.struct("ts", *SUMMARY), "ts").alias("r")).select("symbol", "r.*")
    return last.withColumns({
        "trend_strength": F.when(F.col("adx") > 25, "strong").otherwise("weak"),
        "momentum_state": momentum_state(F.col("rsi"), F.col("stoch_k")),
        "volatility_state": volatility_state(F.col("bb_width"), F.col("vol_30")),
        "volume_trend": F.when(F.col("volume_ratio") > 1.2, "increasing").otherwise("normal")})
