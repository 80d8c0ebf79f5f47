"""Vectorised backtests. A strategy is any function DataFrame -> DataFrame that adds a `signal` column to bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.guards import div, ln
from candlewick.functions.windows import over
from candlewick.operators.indicators import rsi_strict

Strategy = Callable[[DataFrame], DataFrame]


def sma_cross(short: int = 20, long: int = 50) -> Strategy:
    """+1 while the short mean is above the long one, -1 below, 0 otherwise."""
    if short >= long:
        raise ValueError("short must be below long")

    def apply(bars: DataFrame) -> DataFrame:
        s = over(bars)
        return bars.withColumn("signal", F.coalesce(F.signum(s.mean("close", short) - s.mean("close", long)), F.lit(0.0)))

    return apply


def rsi_reversion(low: float = 30.0, high: float = 70.0, n: int = 14) -> Strategy:
    """Long below the low mark, short above the high one."""

    def apply(bars: DataFrame) -> DataFrame:
        r = F.col("_rsi")
        return rsi_strict(bars, n, "_rsi").withColumn("signal", F.when(r < low, 1.0).when(r > high, -1.0).otherwise(0.0)).drop("_rsi")

    return apply


def backtest(bars: DataFrame, strategy: Strategy, fee_bps: float = 5.0) -> DataFrame:
    """Position is the previous signal; net return is log return times position minus the fee on position changes."""
    rows = bars.transform(strategy)
    s = over(rows)
    rows = rows.withColumn("position", F.coalesce(s.lag("signal"), F.lit(0.0)))
    turn = F.coalesce(F.abs(s.diff("position")), F.lit(0.0))
    rows = rows.withColumns({"log_return": F.coalesce(ln(div("close", s.lag("close"))), F.lit(0.0)), "cost": turn * (fee_bps / 1e4)})
    rows = rows.withColumn("net_return", F.col("log_return") * F.col("position") - F.col("cost"))
    return rows.withColumn("equity", F.exp(F.sum("net_return").over(s.running)))


def backtest_stats(result: DataFrame, year: float = 365.0, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Total and annual return, population volatility and Sharpe ratio."""
    r = F.col("net_return")
    annual, vol = F.avg(r) * year, F.stddev_pop(r) * year ** 0.5
    return result.groupBy(*by).agg((F.exp(F.sum(r)) - 1).alias("total_return"), F.sum(r).alias("log_growth"), annual.alias("annual_return"),
                                   vol.alias("annual_volatility"), F.coalesce(div(annual, vol), F.lit(0.0)).alias("sharpe"))


def cross_flags(bars: DataFrame, fast: int = 3, slow: int = 9) -> DataFrame:
    """`above` is 1 while the fast mean exceeds the slow one; `turn` is +1 on a buy row and -1 on a sell row."""
    s = over(bars)
    out = bars.withColumn("above", F.coalesce(s.mean("close", fast) > s.mean("close", slow), F.lit(False)).cast("int"))
    return out.withColumn("turn", s.diff("above"))


def round_trips(flagged: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Pair each buy with the next sell: flags alternate, so the k-th turn row holds the previous turn as its entry."""
    turns = flagged.filter(F.col("turn") != 0)
    s = over(turns, by=by)
    out = turns.withColumns({"entry_ts": s.lag("ts"), "entry_price": s.lag("close"), "_t": s.lag("turn")})
    return out.filter((F.col("turn") == -1) & (F.col("_t") == 1)).select(
        *by, "entry_ts", F.col("ts").alias("exit_ts"), "entry_price", F.col("close").alias("exit_price"),
        (F.col("close") - F.col("entry_price")).alias("gain"))


def trade_metrics(trades: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Hit rate, mean and total gain, days in the market."""
    g = F.col("gain")
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.avg((g > 0).cast("double")).alias("hit_rate"), F.avg(g).alias("payoff"),
                                   F.sum(g).alias("total"), F.sum(F.datediff("exit_ts", "entry_ts")).alias("exposure_days"))


def trade_drawdown(trades: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Largest fall of the cumulative gain with the trades where it starts and ends."""
    s = over(trades, by=by, order=("exit_ts",))
    rows = trades.withColumns({"n": s.position(), "total": F.sum("gain").over(s.running)})
    rows = rows.withColumn("peak", F.max(F.struct(F.col("total").alias("v"), (-F.col("n")).alias("n"))).over(s.running))
    rows = rows.withColumn("drop", F.col("peak.v") - F.col("total"))
    worst = F.max_by(F.struct(F.col("drop"), (-F.col("peak.n")).alias("a"), F.col("n").alias("b")), F.struct("drop", -F.col("n")))
    return rows.groupBy(*by).agg(worst.alias("w")).select(*by, F.col("w.drop").alias("max_drawdown"), F.col("w.a").alias("start_trade"),
                                                         F.col("w.b").alias("end_trade"))


def scorecard(trades: DataFrame, by: str = "strategy") -> DataFrame:
    """Figures per strategy over its trades, and each figure as a share of the column maximum."""
    g = F.col("gain")
    fall = trade_drawdown(trades, (by, "symbol")).groupBy(by).agg(F.max("max_drawdown").alias("max_drawdown"))
    rows = trades.groupBy(by).agg(
        F.count(F.lit(1)).cast("double").alias("trades"), div(F.avg(g), F.stddev_pop(g)).alias("sharpe"), F.avg(g).alias("payoff"),
        div(F.count_if(g > 0), F.count_if(g <= 0)).alias("win_loss"), (100 * F.avg((g > 0).cast("double"))).alias("hit_pct"),
        F.sum(g).alias("profit")).join(fall, by)
    names = ("trades", "max_drawdown", "sharpe", "payoff", "win_loss", "hit_pct", "profit")
    whole = Window.partitionBy()  # one row per strategy
    return rows.withColumns({f"{n}_scaled": div(n, F.max(n).over(whole)) for n in names})
