"""Multi-factor scores: one row per asset from its bars. Each factor adds last-row or whole-series aggregates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.blocks import mean_abs_corr
from candlewick.functions.guards import clip, div
from candlewick.functions.ranks import share_at_most
from candlewick.functions.tables import stored
from candlewick.functions.windows import over
from candlewick.operators.indicators import bollinger, rsi_inf

WEIGHTS = {"momentum": 0.40, "mean_reversion": 0.20, "volume_liquidity": 0.10, "volatility_regime": 0.10,
           "correlation_dynamics": 0.10, "market_cycle": 0.05, "local_factors": 0.05}
MIN_ROWS = 156


def last_row(df: DataFrame, *columns: str) -> DataFrame:
    """Newest values of `columns` per symbol, as one aggregate instead of a sort."""
    return df.groupBy("symbol").agg(F.max_by(F.struct(*columns), "ts").alias("_l")).select("symbol", "_l.*")


WINDOWS = (21, 63, 126)
DECAY = 0.94
LOCAL = ("momentum", "mean_reversion", "volume_liquidity", "volatility_regime", "local_factors")
#: Of these, the ones that read whole series; the others look back at most NEWEST bars from the newest one, as the correlations do.
LONG = ("momentum", "volatility_regime", "local_factors")
NEWEST = 60


def _momentum() -> Column:
    part = lambda n: div(f"p{n}", F.greatest(F.col(f"s{n}") * 252 ** 0.5, F.lit(0.01)))
    top = functools.reduce(lambda a, b: a + b, [part(n) * DECAY ** i for i, n in enumerate(WINDOWS)])
    return (F.tanh(top / sum(DECAY ** i for i in range(len(WINDOWS)))) + 1) / 2


def _mean_reversion() -> Column:
    band = F.when(F.col("bb_upper").isNull(), 0.5).otherwise(1 - F.col("bb_position"))
    return clip((100 - F.coalesce("rsi_inf", F.lit(50.0))) / 100 * 0.6 + band * 0.4, 0, 1)


def _volume_liquidity(sigma: float = 2.0) -> Column:
    odd = F.when(F.col("vs30") > 0, F.least(F.abs(div(F.col("v5") - F.col("v30"), "vs30")) / sigma, F.lit(1.0))).otherwise(0.0)
    return clip(odd * 0.4 + F.least(div(F.log1p("v5"), F.log1p(F.col("v30") * 10)), F.lit(1.0)) * 0.6, 0, 1)


def _volatility(limit: float = 1.5) -> Column:
    ratio = F.coalesce(div("vol", F.when(F.col("vol_median") > 0, F.col("vol_median"))), F.lit(1.0))
    return clip(F.when(ratio > limit, 1 / (1 + ratio - limit)).otherwise(0.5 + 0.5 * (limit - ratio) / limit), 0, 1)


def _local() -> Column:
    ratio = F.coalesce(div("v7", F.when(F.col("volume_median") > 0, F.col("volume_median"))), F.lit(1.0))
    return clip(F.least(ratio, F.lit(2.0)) / 2, 0, 1)


EXPR = {"momentum": _momentum, "mean_reversion": _mean_reversion, "volume_liquidity": _volume_liquidity,
        "volatility_regime": _volatility, "local_factors": _local}


def _summed(bars: DataFrame, names: tuple[str, ...], *more: Column) -> DataFrame:
    """One row per asset of what the factors read, and of `more` aggregates: one windowed pass and one aggregate."""
    s = over(bars)
    rows, newest, aggs = bars, [], []
    if "momentum" in names:
        rows = rows.withColumns({**{f"p{n}": div("close", s.lag("close", n - 1)) - 1 for n in WINDOWS},
                                 **{f"c{n}": s.change("close", n) for n in WINDOWS}})
        newest += [f"p{n}" for n in WINDOWS]
        aggs += [F.stddev_samp(f"c{n}").alias(f"s{n}") for n in WINDOWS]
    if "mean_reversion" in names:
        rows = bollinger(rsi_inf(rows))
        newest += ["rsi_inf", "bb_position", "bb_upper"]
    if "volume_liquidity" in names:
        rows = rows.withColumns({"v5": s.mean("volume", 5), "v30": s.mean("volume", 30), "vs30": s.std("volume", 30)})
        newest += ["v5", "v30", "vs30"]
    if "volatility_regime" in names:
        rows = rows.withColumn("r", s.change("close")).withColumn("vol", s.std("r", 30) * 252 ** 0.5)
        newest.append("vol")
        aggs.append(F.percentile("vol", F.lit(0.5)).alias("vol_median"))
    if "local_factors" in names:
        rows = rows.withColumn("v7", s.mean("volume", 7))
        newest.append("v7")
        aggs.append(F.percentile("volume", F.lit(0.5)).alias("volume_median"))
    agg = rows.groupBy("symbol").agg(F.max_by(F.struct(*newest), "ts").alias("l"), F.count(F.lit(1)).alias("rows"),
                                     *aggs, *more)
    return agg.select("symbol", "rows", "l.*", *[c for c in agg.columns if c not in ("symbol", "rows", "l")])


def factors(bars: DataFrame, names: tuple[str, ...] = LOCAL) -> DataFrame:
    """The asked per-asset factors, however many, from one pass over the bars."""
    return _summed(bars, names).select("symbol", "rows", *[EXPR[n]().alias(n) for n in names])


def one_factor(bars: DataFrame, name: str) -> DataFrame:
    return factors(bars, (name,)).drop("rows")


def correlation_score(bars: DataFrame, n: int = 60, penalty: float = 0.5, common: int = 20, blocks: int | None = None) -> DataFrame:
    """1 minus the mean absolute correlation with every other asset over the newest n returns, at most `penalty` off."""
    s = over(bars)
    tail = bars.withColumns({"_r": s.change("close"), "_newest": s.newest(n)}).filter("_newest").select("symbol", "ts", "_r")
    return _diversity(tail, penalty, common, blocks)


def _diversity(tail: DataFrame, penalty: float = 0.5, common: int = 20, blocks: int | None = None) -> DataFrame:
    """`correlation_score` from the newest returns `_r`."""
    return mean_abs_corr(tail, "_r", common, blocks).select(
        "symbol", F.coalesce(1 - F.least("mean_abs_corr", F.lit(penalty)), F.lit(0.5)).alias("correlation_dynamics"))


def with_period(bars: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """Bars with the return over n of them, and its aggregate `period_return` per symbol: the newest, 0 when there are fewer bars."""
    return bars.withColumn("_p", div("close", over(bars).lag("close", n - 1)) - 1), F.coalesce(F.max_by("_p", "ts"), F.lit(0.0)).alias("period_return")


def period_return(bars: DataFrame, n: int = 30) -> DataFrame:
    """Return over the newest n bars per symbol, 0 when there are fewer."""
    rows, newest = with_period(bars, n)
    return rows.groupBy("symbol").agg(newest)


def benchmark_return(returns: DataFrame, benchmark: str | None) -> Column:
    """One value: the benchmark's period return, of a small table of them. None takes the first asset by name."""
    if benchmark is None:
        return returns.agg(F.min_by("period_return", "symbol").alias("b")).scalar()
    return returns.filter(F.col("symbol") == benchmark).agg(F.max("period_return").alias("b")).scalar()


def _cycle(returns: DataFrame, benchmark: str | None) -> Column:
    return ((F.tanh((F.col("period_return") - benchmark_return(returns, benchmark)) * 5) + 1) / 2).alias("market_cycle")


def cycle_score(bars: DataFrame, benchmark: str | None, n: int = 30) -> DataFrame:
    returns = stored(period_return(bars, n), "period-returns")
    return returns.select("symbol", _cycle(returns, benchmark))


def composite(bars: DataFrame, benchmark: str | None, weights: dict[str, float] = WEIGHTS, min_rows: int = MIN_ROWS,
              blocks: int | None = None) -> DataFrame:
    """All factors and their weighted sum for assets with enough bars, with the percentile rank.

    The bars are read once: what needs whole series is summed, and the newest bars, which the other factors need, stay with the sums as a
    list. That table of one row per asset is stored, and the result is kept; the bars are not.
    """
    if not 0.98 <= sum(weights.values()) <= 1.02:
        raise ValueError("factor weights must sum to 1")
    s = over(bars)
    rows, period = with_period(bars.withColumns({"_r": s.change("close"), "_newest": s.newest(NEWEST)}), 30)
    bar = F.when(F.col("_newest"), F.struct("ts", "close", "volume", "_r"))
    assets = stored(_summed(rows, LONG, period, F.collect_list(bar).alias("_tail")), "asset-sums")
    tail = assets.select("symbol", F.inline("_tail"))
    short = tuple(n for n in LOCAL if n not in LONG)
    parts = assets.filter(F.col("rows") >= min_rows).select("symbol", *[EXPR[n]().alias(n) for n in LONG], _cycle(assets, benchmark)).join(
        factors(tail, short).drop("rows"), "symbol").join(_diversity(tail, blocks=blocks), "symbol")
    total = functools.reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weights.items()])
    scores = parts.select("symbol", *WEIGHTS, clip(total, 0, 1).alias("composite_score")).persist()
    return percentile_rank(scores)


def component_map(scores: DataFrame) -> DataFrame:
    """Factors as one map column."""
    return scores.withColumn("component_scores", F.map_from_arrays(
        F.array(*[F.lit(k) for k in WEIGHTS]), F.array(*WEIGHTS))).drop(*WEIGHTS)


def percentile_rank(scores: DataFrame, value: str = "composite_score") -> DataFrame:
    return share_at_most(scores, value, "percentile_rank").withColumn("percentile_rank", F.col("percentile_rank") * 100)


def breakdown(bars: DataFrame, windows: tuple[int, ...] = (21, 63, 126), n: int = 30, rate: float = 0.02) -> DataFrame:
    """Window returns, strength-index flags, and the newest 30-bar volatility, drawdown and Sharpe ratio."""
    s = over(bars)
    rows = rsi_inf(bars).withColumns({f"return_{w}d": div("close", s.lag("close", w - 1)) - 1 for w in windows})
    rows = rows.withColumns({"_r": s.change("close"), "_back": s.from_last()})
    rows = rows.withColumns({"_sd": s.std("_r", n), "_mean": s.mean("_r", n)})
    tail = rows.filter(F.col("_back") <= n)
    worst = tail.withColumn("_d", div("close", F.max("close").over(over(tail).running)) - 1).groupBy("symbol").agg(
        F.abs(F.min("_d")).alias("max_drawdown_30d"))
    last = last_row(rows, *[f"return_{w}d" for w in windows], "rsi_inf", "_sd", "_mean")
    rsi = F.coalesce("rsi_inf", F.lit(50.0))
    return last.join(worst, "symbol").select(
        "symbol", *[f"return_{w}d" for w in windows], rsi.alias("rsi"), (rsi < 30).alias("rsi_oversold"),
        (rsi > 70).alias("rsi_overbought"), (F.col("_sd") * 252 ** 0.5).alias("volatility_30d"), "max_drawdown_30d",
        F.coalesce(div(F.col("_mean") * 252 - rate, F.col("_sd") * 252 ** 0.5), F.lit(0.0)).alias("sharpe_30d"))


def top_assets(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last("composite_score"), "symbol").limit(n)


def summary(scores: DataFrame, n: int = 10) -> DataFrame:
    """One row: distribution of scores, mean of each factor, the n best symbols in order."""
    s = F.col("composite_score")
    stats = scores.agg(F.count(F.lit(1)).alias("total_assets"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
                       F.min(s).alias("min"), F.max(s).alias("max"), F.percentile(s, F.lit(0.5)).alias("median"),
                       *[F.avg(k).alias(f"avg_{k}") for k in WEIGHTS])
    best = top_assets(scores, n).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(
        F.struct((-s).alias("s"), "symbol"))), lambda x: x["symbol"])).alias("top"))
    return stats.withColumn("top_assets", best.scalar())
