"""Market regime: trend, volatility and volume signals, their combination, history and transitions.

`signals(bars)` gives the state at every bar with expanding statistics; `detect` gives the newest state per symbol from
plain aggregates, linear in the bars.
"""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.guards import clip, div
from candlewick.functions.orderstats import expanding_quantile
from candlewick.functions.windows import over

TREND_WINDOWS = (20, 50, 200)
MIN_ROWS = 230
REGIMES = ("bull", "bear", "sideways", "volatile", "unknown")


def trend_signal(bars: DataFrame, windows: tuple[int, ...] = TREND_WINDOWS, slope: int = 4) -> DataFrame:
    """Distance to each mean plus the slope of the mean, weighted by window length, squashed to -1..1."""
    s = over(bars)
    out = bars.withColumns({f"_sma_{n}": s.mean("close", n) for n in windows})
    out = out.withColumns({f"_t_{n}": div("close", f"_sma_{n}") - 1 + div(f"_sma_{n}", s.lag(f"_sma_{n}", slope)) - 1
                           for n in windows})
    have = lambda n: F.col(f"_t_{n}").isNotNull()
    top = sum((F.when(have(n), n * F.col(f"_t_{n}")).otherwise(0.0) for n in windows), F.lit(0.0))
    weight = sum((F.when(have(n), float(n)).otherwise(0.0) for n in windows), F.lit(0.0))
    return out.withColumn("trend_signal", F.tanh(10 * div(top, weight))).drop(
        *[f"_{k}_{n}" for n in windows for k in ("sma", "t")])


def _vol(bars: DataFrame, n: int = 30) -> DataFrame:
    s = over(bars)
    return bars.withColumn("_r", s.change("close")).withColumn("vol", s.std("_r", n) * 252 ** 0.5).drop("_r")


def volatility_scale(ratio: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """0 at half the median volatility or less, 1 at twice or more, linear between."""
    return clip((ratio - low) / (high - low), 0.0, 1.0)


def volatility_signal(bars: DataFrame, n: int = 30) -> DataFrame:
    """Rolling volatility against its median so far."""
    out = expanding_quantile(_vol(bars, n), "vol", "_median")
    ratio = F.coalesce(div("vol", F.when(F.col("_median") > 0, F.col("_median"))), F.when(F.col("vol").isNotNull(), 1.0))
    return out.withColumn("volatility_signal", volatility_scale(ratio)).drop("vol", "_median")


def volume_signal(bars: DataFrame, n: int = 30, recent: int = 5, surge: float = 1.5) -> DataFrame:
    """Recent mean volume over the n-bar mean, 1 at `surge` times or more."""
    s = over(bars)
    base = s.mean("volume", n)
    ratio = F.when(base > 0, div(s.mean("volume", recent), base)).when(base.isNotNull(), 1.0)
    return bars.withColumn("volume_signal", clip(ratio / surge, 0.0, 1.0))


def classify(trend: Column, vol: Column, volume: Column, state: Column | None = None, states: int = 3) -> Column:
    """Struct (regime, confidence, strength) from the signals; a latent state adds a tenth of its position."""
    hidden = F.lit(0.0) if state is None else F.coalesce((state / (states - 1) * 2 - 1) * 0.1, F.lit(0.0))
    total = trend * 0.4 + hidden
    size = F.abs(total)
    case = F.when(vol > 0.8, "volatile").when(size < 0.1, "sideways").when(total > 0.02, "bull").when(
        total < -0.02, "bear").otherwise("sideways")
    pick = lambda a, b, c, d: F.when(vol > 0.8, a).when(size < 0.1, b).when(total > 0.02, c).when(total < -0.02, d).otherwise(0.5)
    sure = F.least(size * 2, F.lit(1.0))
    confidence = pick(vol, 1 - size * 5, sure, sure)
    strength = pick(vol, volume * 0.2, size * (1 - vol * 0.5), size * (1 - vol * 0.3))
    weak = confidence < 0.6
    return F.struct(F.when(weak, "unknown").otherwise(case).alias("regime"),
                    F.when(weak, 0.0).otherwise(confidence).alias("confidence"),
                    F.when(weak, 0.0).otherwise(strength).alias("strength"))


def unknown() -> Column:
    return F.struct(F.lit("unknown").alias("regime"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("strength"))


def signals(bars: DataFrame) -> DataFrame:
    """Signals and regime at every bar; fewer than 230 bars so far give `unknown`."""
    out = volume_signal(volatility_signal(trend_signal(bars)))
    seen = over(bars).position()
    case = classify(F.col("trend_signal"), F.col("volatility_signal"), F.col("volume_signal"))
    return out.withColumn("_n", seen).withColumn("_c", F.when(F.col("_n") < MIN_ROWS, unknown()).otherwise(case)).select(
        "symbol", "ts", "trend_signal", "volatility_signal", "volume_signal", "_c.*")


def latest_signals(bars: DataFrame) -> DataFrame:
    """Newest signals and percentiles per symbol: two aggregates over one windowed pass."""
    s = over(bars)
    rows = _vol(volume_signal(trend_signal(bars))).withColumn("_v5", s.mean("volume", 5))
    last = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ts").alias("ts"), F.percentile("vol", F.lit(0.5)).alias("_median"),
        F.max_by(F.struct("trend_signal", "volume_signal", "vol", "_v5"), "ts").alias("l")).select(
        "symbol", "rows", "ts", "_median", "l.trend_signal", "l.volume_signal", F.col("l.vol").alias("_cur"),
        F.col("l._v5").alias("_cv5"))
    share = rows.select("symbol", "vol", "volume").join(last.select("symbol", "_cur", "_cv5"), "symbol").groupBy("symbol").agg(
        div(F.count_if(F.col("vol") <= F.col("_cur")), F.count(F.lit(1)) - 1).alias("volatility_percentile"),
        div(F.count_if(F.col("volume") <= F.col("_cv5")), F.count(F.lit(1))).alias("volume_percentile"))
    ratio = F.coalesce(div("_cur", F.when(F.col("_median") > 0, F.col("_median"))), F.lit(1.0))
    return last.join(share, "symbol").withColumn("volatility_signal", volatility_scale(ratio)).drop("_median", "_cur", "_cv5")


def detect(bars: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Current regime per symbol with its supporting figures; `states` adds a latent state per symbol."""
    out = latest_signals(bars)
    state = None
    if states is not None:
        out, state = out.join(states.select("symbol", "latent_state"), "symbol", "left"), F.col("latent_state")
    case = classify(F.col("trend_signal"), F.col("volatility_signal"), F.col("volume_signal"), state)
    return out.withColumn("_c", F.when(F.col("rows") < MIN_ROWS, unknown()).otherwise(case)).select(
        "symbol", "ts", "_c.*", "trend_signal", "volatility_signal", "volume_signal",
        F.abs("trend_signal").alias("trend_strength"), "volatility_percentile", "volume_percentile")


def latent_states(bars: DataFrame, k: int = 3, lookback: int = 252, seed: int = 42) -> DataFrame:
    """Newest state per symbol from a Gaussian mixture over (return, volume change), states ordered by mean return."""
    s = over(bars)
    rows = bars.withColumns({"_r": s.change("close"), "_v": s.change("volume"), "_back": s.from_last()}).filter(
        F.col("_back") <= lookback).dropna(subset=["_r", "_v"]).select("symbol", "ts", "_r", "_v")
    data = VectorAssembler(inputCols=["_r", "_v"], outputCol="features").transform(rows)
    model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(data)
    means = sorted((float(g.mean[0]), i) for i, g in enumerate(model.gaussians))
    order = F.create_map(*[x for rank, (_, i) in enumerate(means) for x in (F.lit(i), F.lit(rank))])
    scored = model.transform(data).withColumn("latent_state", order[F.col("prediction")])
    p = F.array_max(vector_to_array("probability"))
    return scored.withColumn("_p", p).groupBy("symbol").agg(
        F.max("ts").alias("ts"), F.max_by("latent_state", "ts").alias("latent_state"), F.max_by("_p", "ts").alias("probability"))


def history(regimes: DataFrame, keep: int = 100) -> DataFrame:
    """Change date, previous regime and duration at each of the newest `keep` detections."""
    s = over(regimes)
    before = s.lag("regime")
    out = regimes.withColumns({"_n": s.position(), "_from": F.when(F.col("regime") != before, before), "_back": s.from_last()})
    out = out.withColumns({
        "change_date": F.last(F.when(F.col("_from").isNotNull(), F.col("ts")), ignorenulls=True).over(s.running),
        "previous_regime": F.last("_from", ignorenulls=True).over(s.running)})
    days = F.coalesce(F.datediff("ts", "change_date"), F.col("_n") - 1)
    return out.withColumn("duration_days", days).filter(F.col("_back") <= keep).select(
        "symbol", "ts", "regime", "confidence", "strength", "change_date", "previous_regime", "duration_days")


def summary(hist: DataFrame, n: int = 30) -> DataFrame:
    """Current state and how often each regime was seen in the newest n detections."""
    tail = hist.withColumn("_back", over(hist).from_last()).filter(F.col("_back") <= n)
    last = F.max_by(F.struct("regime", "confidence", "strength", "duration_days", "previous_regime"), "ts").alias("l")
    return tail.groupBy("symbol").agg(last, *[F.count_if(F.col("regime") == r).alias(f"seen_{r}") for r in REGIMES]).select(
        "symbol", F.col("l.regime").alias("current_regime"), "l.confidence", "l.strength", "l.duration_days",
        "l.previous_regime", *[f"seen_{r}" for r in REGIMES])


def transitions(hist: DataFrame, min_rows: int = 10) -> DataFrame:
    """Share of each from-to pair among all steps of a symbol's history."""
    s = over(hist)
    steps = hist.withColumns({"from_regime": s.lag("regime"), "_n": F.count(F.lit(1)).over(s.all)}).filter(
        F.col("from_regime").isNotNull() & (F.col("_n") >= min_rows))
    return steps.groupBy("symbol", "from_regime", F.col("regime").alias("to_regime"), "_n").agg(
        F.count(F.lit(1)).alias("steps")).withColumn("probability", F.col("steps") / (F.col("_n") - 1)).drop("_n")
