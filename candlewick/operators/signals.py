"""Predictive signals: one feature row per asset, then up to five signal rows from it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.guards import div
from candlewick.functions.tables import stored
from candlewick.functions.windows import over
from candlewick.operators.indicators import rsi_inf
from candlewick.operators.scoring import benchmark_return, with_period

# fixed values: weight of each signal type in the combination; any other type weighs 0.1
WEIGHTS = {"momentum_persistence": 0.25, "mean_reversion": 0.20, "breakout": 0.20, "volume_flow": 0.15,
           "cycle_signal": 0.10, "ml_prediction": 0.10}
MIN_ROWS = 100
#: Newest bars that the moving figures read: windows of 63, and one more.
NEWEST = 64
FIELDS = ("signal_type", "direction", "strength", "confidence", "horizon_days", "entry_price", "target_price",
          "stop_loss", "expected_return")


def features(bars: DataFrame, benchmark: str | None, day: int) -> DataFrame:
    """Everything the signals read, one row per asset with at least 100 bars.

    The bars are read once: long lags, seasonal means and the newest bars of each asset are stored as one row, and the moving figures,
    of which only the newest count, are computed on those newest bars. `day` is the day of month the seasonal signal looks at; the clock is never read.
    """
    s = over(bars)
    c = F.col
    rows, period = with_period(bars, 60)
    rows = rows.withColumns({
        "r": s.change("close"), "m1": div(s.lag("close", 20), s.lag("close", 41)) - 1,
        "m3": div("close", s.lag("close", 62)) - 1, "m6": div("close", s.lag("close", 125)) - 1, "newest": s.newest(NEWEST)})
    season = [F.avg(F.when(F.dayofmonth("ts") == d, c("r"))).alias(f"d{d}") for d in range(1, 32)]
    tail = F.collect_list(F.when(c("newest"), F.struct("ts", "high", "low", "close", "volume", "r")))
    assets = stored(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("m1", "m3", "m6"), "ts").alias("l"),
                                               period, tail.alias("tail"), *season), "signal-sums")
    enough = assets.filter(c("n") >= MIN_ROWS)
    days = F.array_compact(F.array(*[c(f"d{d}") for d in range(1, 32)]))
    mean = F.aggregate(days, F.lit(0.0), lambda a, x: a + x) / F.size(days)
    spread = F.sqrt(div(F.aggregate(days, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), F.size(days) - 1))
    relative = c("period_return") - benchmark_return(assets, benchmark)
    out = enough.select("symbol", "n", "l.*", c(f"d{day}").alias("seasonal_return"), spread.alias("seasonal_std"),
                        ((F.tanh(relative * 3) + 1) / 2).alias("cycle_position"))
    return out.join(_moving(enough.select("symbol", F.inline("tail"))), "symbol")


def _moving(tail: DataFrame) -> DataFrame:
    """Newest moving figures of each asset from its newest bars with their returns `r`."""
    s = over(tail)
    c = F.col
    rows = rsi_inf(tail).withColumns({
        "sma": s.mean("close", 20), "sd": s.std("close", 20), "h10": s.high("high", 10), "l10": s.low("low", 10),
        "v20": s.mean("volume", 20), "first20": s.lag("close", 19), "fv": s.lag("volume", 19),
        "cv": c("close") * c("volume"), "last20": s.newest(20)})
    rows = rows.withColumns({
        "up": (c("r") > 0).cast("double"), "flow": F.signum(s.diff("close")) * c("volume")}).withColumns({
            "up63": s.mean("up", 63), "sd63": s.std("r", 63), "resistance": s.low("h10", 5), "support": s.high("l10", 5),
            "vwap": div(s.total("cv", 20), s.total("volume", 20)), "moved": s.total("flow", 19)})
    newest = ["close", "volume", "up63", "sd63", "sma", "sd", "rsi_inf", "resistance", "support", "v20", "first20", "fv", "vwap", "moved"]
    # the newest 20 bars as one bounded array per asset
    last = F.array_sort(F.collect_list(F.when(c("last20"), F.struct("ts", "close", "volume"))))
    agg = rows.groupBy("symbol").agg(F.max_by(F.struct(*newest), "ts").alias("l"), last.alias("last"))
    busy = F.transform(F.filter("last", lambda t: t["volume"] > 2 * c("l.v20")), lambda t: t["close"])
    out = agg.select("symbol", "l.*", busy.alias("busy"))
    steps = F.zip_with(F.slice("busy", 2, 20), F.slice("busy", 1, F.greatest(F.size("busy") - 1, F.lit(0))), lambda a, b: div(a, b) - 1)
    return out.withColumn("busy_return", F.when(F.size("busy") > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (
        F.size("busy") - 1))).withColumn("busy_days", F.size("busy")).drop("busy")


def _signal(kind: str, direction: Column, strength: Column, confidence: Column, horizon: int, expected: Column,
            target: Column | None = None, stop: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(F.lit(kind).alias("signal_type"), direction.alias("direction"), strength.cast("double").alias("strength"),
                    confidence.cast("double").alias("confidence"), F.lit(horizon).alias("horizon_days"),
                    F.col("close").alias("entry_price"), (none if target is None else target).alias("target_price"),
                    (none if stop is None else stop).alias("stop_loss"), expected.alias("expected_return"))


def momentum_persistence(threshold: float = 0.3) -> Column:
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    score = zero("m1") * 0.5 + zero("m3") * 0.3 + zero("m6") * 0.2
    steady = F.abs(c("up63") - 0.5) * 2
    way = F.when(score > 0.05, "bullish").when(score < -0.05, "bearish").otherwise("neutral")
    strength = F.when(F.abs(score) > 0.05, F.least(F.abs(score) * 5, F.lit(1.0))).otherwise(0.5)
    sure = steady * (1 - F.least(c("sd63") * 252 ** 0.5 / 2, F.lit(0.8)))
    return F.when((c("n") >= 126) & (steady >= threshold), _signal("momentum_persistence", way, strength, sure, 21, score))


def mean_reversion(low: float = 30.0, high: float = 70.0, k: float = 2.0) -> Column:
    c = F.col
    band = div(c("close") - (c("sma") - k * c("sd")), 2 * k * c("sd"))
    bull = ((c("rsi_inf") < low) | (band < 0.1)) & (c("close") < c("sma"))
    bear = ((c("rsi_inf") > high) | (band > 0.9)) & (c("close") > c("sma"))
    strength = F.least(F.when(bull, (low - c("rsi_inf")) / low + 0.1 - band).otherwise(
        (c("rsi_inf") - high) / (100 - high) + band - 0.9), F.lit(1.0))
    return F.when(bull | bear, _signal("mean_reversion", F.when(bull, "bullish").otherwise("bearish"), strength, strength * 0.8, 10,
                                       div(c("sma") - c("close"), "close"), c("sma")))


def breakout(move: float = 0.02, volume: float = 1.5) -> Column:
    c = F.col
    up, down = div(c("close") - c("resistance"), "resistance"), div(c("support") - c("close"), "support")
    loud = c("volume") > c("v20") * volume
    below, above = loud & (down > move), loud & (up > move)
    strength = F.least(F.when(below, down).otherwise(up) * 10, F.lit(1.0))
    target = F.when(below, c("support") * (1 - down)).otherwise(c("resistance") * (1 + up))
    return F.when(below | above, _signal(
        "breakout", F.when(below, "bearish").otherwise("bullish"), strength, strength * 0.7, 14,
        div(target - c("close"), "close"), target, F.when(below, c("support") * 1.02).otherwise(c("resistance") * 0.98)))


def volume_flow(divergence: float = 0.3) -> Column:
    c = F.col
    price = div("close", "first20") - 1
    flow = F.when(c("fv") != 0, div(c("fv") + c("moved"), "fv") - 1).otherwise(0.0)
    strength = F.least(F.abs(flow - price), F.lit(1.0))
    hit = (flow > price + divergence) & (c("close") < c("vwap")) & (c("busy_days") > 0) & (c("busy_return") > 0)
    return F.when(hit, _signal("volume_flow", F.lit("bullish"), strength, strength * 0.6, 7, div(c("vwap") - c("close"), "close"), c("vwap")))


def cycle(threshold: float = 0.25, min_rows: int = 252) -> Column:
    c = F.col
    strength = F.abs(div("seasonal_return", "seasonal_std"))
    way = F.when(c("seasonal_return") > 0, "bullish").when(c("seasonal_return") < 0, "bearish").otherwise("neutral")
    return F.when((c("n") >= min_rows) & (strength >= threshold), _signal(
        "cycle_signal", way, strength, strength * c("cycle_position") * 0.5, 30, c("seasonal_return")))


def rows_of(feats: DataFrame, *signals: Column) -> DataFrame:
    """Signal rows of the features; an asset without a given signal has no row for it."""
    return feats.select("symbol", F.explode(F.array_compact(F.array(*signals))).alias("s")).select("symbol", "s.*")


def all_signals(bars: DataFrame, benchmark: str | None, day: int, persistence: float = 0.3,
                divergence: float = 0.3) -> DataFrame:
    feats = features(bars, benchmark, day)
    return validate(rows_of(feats, momentum_persistence(persistence), mean_reversion(), breakout(), volume_flow(divergence), cycle()))


def signal_features(bars: DataFrame, n: int = 30) -> DataFrame:
    """Mean and deviation of return, mean volume and period return of the newest n bars."""
    s = over(bars)
    tail = bars.withColumn("_back", s.from_last()).filter(F.col("_back") <= n)
    r = tail.withColumn("_r", over(tail).change("close"))
    return r.groupBy("symbol").agg(
        F.avg("_r").alias("mean_return"), F.stddev_samp("_r").alias("volatility"), F.avg("volume").alias("mean_volume"),
        (div(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("period_return"))


def validate(signals: DataFrame) -> DataFrame:
    c = F.col
    return signals.filter((c("strength") > 0) & (c("strength") <= 1) & (c("confidence") > 0) & (c("confidence") <= 1)
                          & (c("horizon_days") > 0) & (c("horizon_days") <= 90)
                          & F.coalesce(F.abs("expected_return") <= 2, F.lit(True)))


def _weight() -> Column:
    return functools.reduce(lambda a, kv: a.when(F.col("signal_type") == kv[0], kv[1]), list(WEIGHTS.items())[1:],
                            F.when(F.col("signal_type") == "momentum_persistence", WEIGHTS["momentum_persistence"])).otherwise(0.1)


def combine(signals: DataFrame) -> DataFrame:
    """One combined signal per asset; a side needs 1.2 times the other's score to win."""
    w = signals.withColumn("_w", _weight())
    score = F.col("strength") * F.col("confidence") * F.col("_w")
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, score)), F.lit(0.0))
    agg = w.groupBy("symbol").agg(
        side("bullish").alias("bull"), side("bearish").alias("bear"),
        div(F.sum(F.col("confidence") * F.col("_w")), F.sum("_w")).alias("confidence"),
        F.floor(F.avg("horizon_days")).alias("horizon_days"), F.avg("expected_return").alias("expected_return"),
        F.count(F.lit(1)).alias("signals"))
    b, e = F.col("bull"), F.col("bear")
    up, down = b > e * 1.2, e > b * 1.2
    return agg.select("symbol", F.when(up, "bullish").when(down, "bearish").otherwise("neutral").alias("direction"),
                      F.when(up, div(b, b + e)).when(down, div(e, b + e)).otherwise(0.5).alias("strength"),
                      "confidence", "horizon_days", "expected_return", "signals")


def summary(signals: DataFrame) -> DataFrame:
    """Counts and means by type and direction with subtotals ('all')."""
    return signals.rollup("signal_type", "direction").agg(
        F.count(F.lit(1)).alias("signals"), F.count_distinct("symbol").alias("assets"),
        F.avg("confidence").alias("avg_confidence"), F.avg("strength").alias("avg_strength")).fillna(
            "all", subset=["signal_type", "direction"])


def top_signals(signals: DataFrame, n: int = 10) -> DataFrame:
    return signals.withColumn("score", F.col("confidence") * F.col("strength")).orderBy(
        F.desc("score"), "symbol", "signal_type").limit(n).select("symbol", "signal_type", "direction", "strength", "confidence")
