"""Returns and risk of single series. Input bars keyed (symbol, ts); output adds columns unless noted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.guards import adjusted_kurt, adjusted_skew, div, ln
from candlewick.functions.series import on_series, rolling, sample_std
from candlewick.functions.windows import over

YEAR = 252.0


def simple_returns(bars: DataFrame, price: str = "close", out: str = "simple_return") -> DataFrame:
    return bars.withColumn(out, over(bars).change(price))


def log_returns(bars: DataFrame, price: str = "close", out: str = "log_return", eps: float = 0.0) -> DataFrame:
    ratio = div(price, over(bars).lag(price))
    return bars.withColumn(out, ln(ratio + eps if eps else ratio))


def cumulative_return(bars: DataFrame) -> DataFrame:
    """Percent growth since the first bar, as a running sum of log growth."""
    out = simple_returns(bars, out="_r")
    return out.withColumn("cumulative_return", F.when(F.col("_r").isNotNull(), 100 * (
        F.exp(F.sum(ln(1 + F.col("_r"))).over(over(bars).running)) - 1))).drop("_r")


def base_return(bars: DataFrame) -> DataFrame:
    """Price change per bar in percent of the first price."""
    s = over(bars)
    return bars.withColumn("base_return", 100 * div(s.diff("close"), F.first("close").over(s.running)))


def rolling_volatility(bars: DataFrame, windows: tuple[int, ...] = (30, 60, 90, 180, 252), year: float = YEAR) -> DataFrame:
    return on_series(log_returns(bars, out="_l"), "_l", lambda x: {
        f"volatility_{n}": rolling(x, n, lambda _, d: sample_std(d)) * year ** 0.5 for n in windows}, tuple(f"volatility_{n}" for n in windows)).drop("_l")


def rolling_sharpe(bars: DataFrame, windows: tuple[int, ...] = (30, 60, 90, 180, 252), rate: float = 0.02,
                   year: float = YEAR) -> DataFrame:

    def ratio(mean: np.ndarray, d: np.ndarray) -> np.ndarray:
        std = sample_std(d)
        return np.where(std > 0, (mean * year - rate) / (std * year ** 0.5), np.nan)

    return on_series(log_returns(bars, out="_l"), "_l", lambda x: {f"sharpe_{n}": rolling(x, n, ratio) for n in windows},
                     tuple(f"sharpe_{n}" for n in windows)).drop("_l")


def drawdown(bars: DataFrame) -> DataFrame:
    """Fall from the running peak, and the worst fall so far."""
    s = over(bars)
    out = bars.withColumn("drawdown", div("close", F.max("close").over(s.running)) - 1)
    return out.withColumn("max_drawdown", F.min("drawdown").over(s.running))


def calmar(bars: DataFrame, year: float = YEAR) -> DataFrame:
    """Annual mean log return of the whole series over the worst fall so far."""
    out = drawdown(log_returns(bars, out="_l"))
    mean = F.avg("_l").over(over(bars).all)
    return out.withColumn("calmar", div(mean * year, F.abs("max_drawdown"))).drop("_l", "drawdown", "max_drawdown")


def rolling_moments(bars: DataFrame, n: int = 60) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis of log returns."""

    def moment(k: int, d: np.ndarray) -> np.ndarray:
        """Standardised moment of windows; NaN without variance."""
        m2 = np.einsum("ij,ij->i", d, d) / n
        return np.where(m2 > 0, (d ** k).mean(axis=1) / m2 ** (k / 2), np.nan)

    out = on_series(log_returns(bars, out="_l"), "_l", lambda x: {
        "_g1": rolling(x, n, lambda _, d: moment(3, d)), "_g2": rolling(x, n, lambda _, d: moment(4, d) - 3)}, ("_g1", "_g2"))
    size = F.lit(float(n))
    return out.withColumns({f"skew_{n}": adjusted_skew(F.col("_g1"), size), f"kurt_{n}": adjusted_kurt(F.col("_g2"), size)}).drop("_l", "_g1", "_g2")


def _at(sorted_values: Column, n: int, q: float) -> Column:
    """Linear-interpolation quantile of a sorted array of n values."""
    low = int((n - 1) * q)
    part = (n - 1) * q - low
    return sorted_values[low] + part * (sorted_values[low + 1] - sorted_values[low])


def _tail_mean(values: Column, bound: Column) -> Column:
    """Mean of the values up to the bound."""
    tail = F.filter(values, lambda x: x <= bound)
    return F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(tail), F.lit(0))


def tail_risk(bars: DataFrame, levels: tuple[float, ...] = (0.95, 0.99), n: int = 252) -> DataFrame:
    """Historical value at risk and expected shortfall; one sorted window serves every level."""
    s, out = over(bars), log_returns(bars, out="_l")
    out = out.withColumn("_w", s.full(F.collect_list, "_l", n)).withColumn("_w", F.array_sort("_w"))
    for level in levels:
        name = round(level * 100)
        out = out.withColumn(f"var_{name}", _at(F.col("_w"), n, 1 - level))
        out = out.withColumn(f"cvar_{name}", _tail_mean(F.col("_w"), F.col(f"var_{name}")))
    return out.drop("_w", "_l")


def rolling_beta(returns: DataFrame, benchmark: str, n: int = 60, value: str = "log_return") -> DataFrame:
    """Sample covariance with the benchmark over its population variance, on common bars."""
    bench = returns.filter(F.col("symbol") == benchmark).select("ts", F.col(value).alias("_b")).dropna()
    both = returns.filter(F.col("symbol") != benchmark).join(bench, "ts").filter(F.col(value).isNotNull())
    f = over(both).frame(n)
    full = F.count("_b").over(f) == n
    return both.withColumn("beta", F.when(full, div(F.covar_samp(value, "_b").over(f), F.var_pop("_b").over(f)))).drop("_b")


def alpha_beta(returns: DataFrame, benchmark: str, value: str = "log_return") -> DataFrame:
    """Least-squares intercept and slope of each asset on the benchmark."""
    bench = returns.filter(F.col("symbol") == benchmark).select("ts", F.col(value).alias("_b")).dropna()
    both = returns.filter(F.col("symbol") != benchmark).join(bench, "ts").filter(F.col(value).isNotNull())
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.regr_intercept(value, "_b").alias("alpha"),
                                      F.regr_slope(value, "_b").alias("beta"))


def stat_summary(bars: DataFrame, rate: float = 0.02, year: float = YEAR, n_tail: int = 252) -> DataFrame:
    """One row per symbol: moments, annual figures, newest tail risk, coverage."""
    r = log_returns(bars)
    # only the newest window counts, so one array a symbol is sorted, not one a bar
    r = r.withColumn("_back", over(r).from_last())
    newest = F.array_sort(F.collect_list(F.when(F.col("_back") <= n_tail, F.col("log_return"))))
    x, n = F.col("log_return"), F.count("log_return")
    return r.groupBy("symbol").agg(
        F.avg(x).alias("mean_return"), (F.avg(x) * year).alias("annual_return"), F.stddev_samp(x).alias("volatility"),
        (F.stddev_samp(x) * year ** 0.5).alias("annual_volatility"),
        div(F.avg(x) * year - rate, F.stddev_samp(x) * year ** 0.5).alias("sharpe"),
        adjusted_skew(F.skewness(x), n).alias("skewness"), adjusted_kurt(F.kurtosis(x), n).alias("kurtosis"),
        F.when(F.size(newest) == n_tail, newest).alias("_w"), F.min(x).alias("min_return"),
        n.alias("observations"), F.max(F.when(x.isNotNull(), F.col("ts"))).alias("latest"),
        (100 * F.count_if(x.isNull()) / F.count(F.lit(1))).alias("missing_pct")).withColumn("var_95", _at(F.col("_w"), n_tail, 0.05)).withColumn(
            "cvar_95", _tail_mean(F.col("_w"), F.col("var_95"))).drop("_w")


def signed_split(bars: DataFrame) -> DataFrame:
    """Positive and negative part of the simple return (0 on the other side)."""
    out = simple_returns(bars)
    r = F.col("simple_return")
    return out.withColumns({"gain": F.when(r.isNotNull(), F.greatest(r, F.lit(0.0))),
                            "loss": F.when(r.isNotNull(), F.least(r, F.lit(0.0)))})


def rolling_price_stats(bars: DataFrame, mean_n: int = 6, std_n: int = 5) -> DataFrame:
    s, out = over(bars), simple_returns(bars, out="_r")
    return out.withColumns({"price_mean": s.mean("close", mean_n), "return_std": s.std("_r", std_n)}).drop("_r")


def rolling_vol_percent(bars: DataFrame, n: int = 12) -> DataFrame:
    """n-bar deviation of returns scaled by sqrt(n), in percent."""
    s, out = over(bars), simple_returns(bars, out="_r")
    return out.withColumn(f"vol_{n}_pct", 100 * s.std("_r", n) * n ** 0.5).drop("_r")


