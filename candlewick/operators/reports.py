"""Exploratory and report tables: the numbers behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.guards import div, ln
from candlewick.functions.windows import over


def null_counts(calendar_bars: DataFrame, column: str = "close") -> DataFrame:
    """Nulls and rows per asset, with the total ('all') and the number of assets."""
    return calendar_bars.rollup("symbol").agg(
        F.count_if(F.col(column).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("assets")).fillna("all", subset=["symbol"])


def _percent(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pct", 100 * over(bars).change("close"))


def describe_returns(bars: DataFrame) -> DataFrame:
    x = F.col("pct")
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)]))
    return _percent(bars).groupBy("symbol").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q.alias("q"),
        F.max(x).alias("max")).select("symbol", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"),
                                      F.col("q")[2].alias("q75"), "max")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width counts per symbol; the last bin includes the maximum, empty bins are left out."""
    span = df.groupBy("symbol").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(div(F.col(value) - F.col("lo"), width)), F.lit(bins - 1))
    rows = df.filter(F.col(value).isNotNull()).join(span, "symbol").withColumns({"bin": F.coalesce(at, F.lit(0)).cast("int"), "width": width})
    return rows.groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("count"), F.first(F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"))


def density(df: DataFrame, value: str, points: int = 40) -> DataFrame:
    """Gaussian kernel density on an even grid per symbol (n^-1/5 bandwidth); terms are summed map-side."""
    stats = df.groupBy("symbol").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"),
                                     F.stddev_samp(value).alias("s"))
    rows = df.filter(F.col(value).isNotNull()).select("symbol", F.col(value).alias("v")).join(stats.filter(F.col("s") > 0), "symbol")
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    h = F.col("s") * F.pow("n", F.lit(-0.2))
    u = (F.col("lo") + F.col("point") * step - F.col("v")) / h
    return grid.groupBy("symbol", "point").agg(
        F.first(F.col("lo") + F.col("point") * step).alias("x"),
        (F.sum(F.exp(-0.5 * u * u)) / F.first(F.col("n") * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def box_stats(df: DataFrame, value: str) -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 interquartile ranges, and the number outside."""
    q = df.groupBy("symbol").agg(F.percentile(value, F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)])).alias("q"))
    b = q.select("symbol", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    rows = df.filter(F.col(value).isNotNull()).join(b, "symbol")
    x = F.col(value)
    inside = (x >= F.col("q1") - 1.5 * iqr) & (x <= F.col("q3") + 1.5 * iqr)
    return rows.groupBy("symbol", "q1", "median", "q3").agg(F.min(F.when(inside, x)).alias("low_whisker"),
                                                            F.max(F.when(inside, x)).alias("high_whisker"), F.count_if(~inside).alias("outliers"))


def risk_return_table(bars: DataFrame, weights: DataFrame | None = None, min_rows: int = 10, year: float = 252.0) -> DataFrame:
    """Annual percent return and risk per asset; with weights, assets above 2 % are labelled."""
    r = _percent(bars).groupBy("symbol").agg(F.count("pct").alias("n"), (F.avg("pct") * year).alias("annual_return"),
                                             (F.stddev_samp("pct") * year ** 0.5).alias("annual_risk")).filter(F.col("n") > min_rows)
    if weights is None:
        return r
    return r.join(weights.select("symbol", "weight"), "symbol", "left").fillna(0.0, ["weight"]).withColumn(
        "label", F.when(F.col("weight") > 0.02, F.col("symbol")))


def equal_weight_report(bars: DataFrame, n: int = 30) -> DataFrame:
    """Per date: mean return of all assets, its growth and its rolling percent volatility. One row per date."""
    day = bars.withColumn("r", over(bars).change("close")).groupBy("ts").agg(F.avg("r").alias("mean_return")).filter(
        F.col("mean_return").isNotNull()).withColumn("symbol", F.lit("market"))
    s = over(day)
    return day.withColumns({
        "log_growth": F.sum(ln(1 + F.col("mean_return"))).over(s.running),
        "volatility_pct": s.std("mean_return", n) * (252 ** 0.5) * 100}).withColumn(
            "growth", F.exp("log_growth")).drop("symbol")


def top_mean_return(bars: DataFrame, n: int = 10) -> DataFrame:
    return _percent(bars).groupBy("symbol").agg(F.avg("pct").alias("mean_return")).orderBy(F.desc("mean_return"), "symbol").limit(n)


def volatility_report(bars: DataFrame, n: int = 15) -> DataFrame:
    """The n most volatile assets with the mean over all assets beside each."""
    vol = _percent(bars).groupBy("symbol").agg((F.stddev_samp("pct") * 252 ** 0.5).alias("volatility"))
    mean = vol.agg(F.avg("volatility"))
    return vol.orderBy(F.desc_nulls_last("volatility"), "symbol").limit(n).withColumn("mean_volatility", mean.scalar())


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("count"))


def top_rows(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), "symbol").limit(n).select("symbol", column)
