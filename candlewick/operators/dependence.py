"""Dependence between assets: matrices in long form (asset_i, asset_j, value), rolling pair figures, portfolio spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.blocks import pair_corr, pair_corrs, pair_cov, pair_moments
from candlewick.functions.guards import div, flag
from candlewick.functions.windows import over


def returns_matrix(bars: DataFrame, value: str = "ret") -> DataFrame:
    """Simple returns on the dates where every asset has one (long form)."""
    r = bars.withColumn(value, over(bars).change("close")).filter(F.col(value).isNotNull()).select("symbol", "ts", value)
    return complete_dates(r)


def complete_dates(series: DataFrame) -> DataFrame:
    """Rows of the dates present for all symbols."""
    assets = series.agg(F.count_distinct("symbol").alias("n"))
    dates = series.groupBy("ts").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == assets.scalar()).select("ts")
    return series.join(dates, "ts", "left_semi")


def corr_matrix(returns: DataFrame, value: str = "ret", min_rows: int = 30, blocks: int | None = None) -> DataFrame:
    m = pair_moments(returns, value, blocks).filter(F.col("n") > min_rows)
    return m.select("asset_i", "asset_j", pair_corr().alias("corr"))


def cov_matrix(returns: DataFrame, value: str = "ret", min_rows: int = 30, year: float = 252.0, blocks: int | None = None) -> DataFrame:
    m = pair_moments(returns, value, blocks).filter(F.col("n") > min_rows)
    return m.select("asset_i", "asset_j", (pair_cov() * year).alias("cov"))


def full_matrix(half: DataFrame, value: str) -> DataFrame:
    """Both triangles of a half-stored matrix."""
    mirrored = half.filter(F.col("asset_i") < F.col("asset_j")).select(
        F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), value)
    return half.select("asset_i", "asset_j", value).unionByName(mirrored)


def corr_summary(corr: DataFrame) -> DataFrame:
    return corr.filter(F.col("asset_i") < F.col("asset_j")).agg(
        F.avg("corr").alias("avg_correlation"), F.max("corr").alias("max_correlation"),
        F.min("corr").alias("min_correlation"), F.stddev_pop("corr").alias("correlation_std"))


def _pair_series(series: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """Aligned values of the listed pairs: (asset_i, asset_j, ts, x, y)."""
    x = series.select(F.col("symbol").alias("asset_i"), "ts", F.col(value).alias("x"))
    y = series.select(F.col("symbol").alias("asset_j"), "ts", F.col(value).alias("y"))
    return pairs.select("asset_i", "asset_j").join(x, "asset_i").join(y, ["asset_j", "ts"]).dropna(subset=["x", "y"])


def rolling_pair_corr(returns: DataFrame, pairs: DataFrame, value: str = "ret", n: int = 30) -> DataFrame:
    """Rolling correlation of each listed pair on its common dates."""
    both = _pair_series(returns, pairs, value)
    s = over(both, by=("asset_i", "asset_j"))
    f = s.frame(n)
    varies = (F.var_pop("x").over(f) > 1e-18) & (F.var_pop("y").over(f) > 1e-18)
    return both.withColumn("correlation", F.when((F.count("x").over(f) == n) & varies, div(
        F.covar_pop("x", "y").over(f), F.stddev_pop("x").over(f) * F.stddev_pop("y").over(f)))).drop("x", "y")


def last_complete(series: DataFrame, n: int) -> DataFrame:
    """The newest n complete dates (empty when there are fewer); n bounds the collected date list."""
    whole = complete_dates(series)
    newest = whole.select("ts").distinct().orderBy(F.desc("ts")).limit(n)
    cut = newest.agg(F.when(F.count(F.lit(1)) >= n, F.min("ts")).alias("t"))
    return whole.filter(F.col("ts") >= cut.scalar())


def window_corr(returns: DataFrame, windows: tuple[int, ...] = (30, 60, 90), value: str = "ret", blocks: int | None = None) -> DataFrame:
    """Correlation matrix of the last w complete rows, one block of rows per window."""
    parts = [pair_moments(last_complete(returns, w), value, blocks).filter(F.col("asset_i") < F.col("asset_j"))
             .select(F.lit(w).alias("window"), "asset_i", "asset_j", pair_corr().alias("corr")) for w in windows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def avg_pairwise_corr(returns: DataFrame, n: int, value: str = "ret") -> DataFrame:
    """Mean of the upper triangle of the rolling correlation matrix, without forming pairs.

    With z the values standardised inside the window, the sum of all correlations is sum over the window of
    (sum over assets of z)^2 / (n - 1): linear in the number of assets.
    """
    whole = complete_dates(returns)
    s = over(whole)
    w = whole.withColumns({"_w": s.full(F.collect_list, value, n), "_m": s.mean(value, n), "_s": s.std(value, n)})
    z = w.filter(F.col("_s") > 1e-12).select("ts", F.posexplode(F.transform("_w", lambda x: (x - F.col("_m")) / F.col("_s"))))
    by_day = z.groupBy("ts", "pos").agg(F.sum("col").alias("z"), F.count(F.lit(1)).alias("k"))
    total = by_day.groupBy("ts").agg((F.sum(F.col("z") * F.col("z")) / (n - 1)).alias("s"), F.max("k").alias("k"))
    return total.select("ts", div(F.col("s") - F.col("k"), F.col("k") * (F.col("k") - 1)).alias("avg_corr"))


def corr_breakdown(returns: DataFrame, short: int = 30, long: int = 90, gap: float = 0.3, value: str = "ret") -> DataFrame:
    a = avg_pairwise_corr(returns, short, value).withColumnRenamed("avg_corr", "short_corr")
    b = avg_pairwise_corr(returns, long, value).withColumnRenamed("avg_corr", "long_corr")
    return a.join(b, "ts", "left").withColumn("breakdown", flag(F.col("long_corr") - F.col("short_corr") > gap))


def diversification_ratio(returns: DataFrame, n: int = 60, value: str = "ret") -> DataFrame:
    """Mean asset deviation over the deviation of the equal-weighted portfolio, rolling over complete dates."""
    whole = complete_dates(returns)
    day = whole.withColumn("_s", over(whole).std(value, n)).groupBy("ts").agg(
        F.avg(value).alias("_p"), F.avg("_s").alias("_v"))
    # one row per date from here on
    book = day.withColumn("symbol", F.lit("portfolio"))
    return book.withColumn("_ps", over(book).std("_p", n)).filter(F.col("_ps").isNotNull()).select(
        "ts", F.coalesce(div("_v", "_ps"), F.lit(1.0)).alias("diversification_ratio"))


def diversification_static(returns: DataFrame, value: str = "ret") -> DataFrame:
    """One row: the same ratio over all complete dates."""
    whole = complete_dates(returns)
    asset = whole.groupBy("symbol").agg(F.stddev_samp(value).alias("s")).agg(F.avg("s").alias("v"))
    book = whole.groupBy("ts").agg(F.avg(value).alias("p")).agg(F.stddev_samp("p").alias("s"))
    return asset.select(div(F.col("v"), book.scalar()).alias("diversification_ratio"))


def spread_analysis(bars: DataFrame, pairs: DataFrame, n: int = 60, entry: float = 2.0, exit: float = 0.5) -> DataFrame:
    """Price ratio of each pair, its rolling z-score and the trading flags."""
    both = _pair_series(bars, pairs, "close").withColumn("ratio", div("x", "y"))
    s = over(both, by=("asset_i", "asset_j"))
    out = both.withColumns({"spread_mean": s.mean("ratio", n), "spread_std": s.std("ratio", n)})
    z = F.col("z_score")
    return out.withColumn("z_score", div(F.col("ratio") - F.col("spread_mean"), "spread_std")).withColumns({
        "long_signal": flag(z < -entry), "short_signal": flag(z > entry), "exit_signal": flag(F.abs(z) < exit)}).drop("x", "y")


def pair_corr_static(series: DataFrame, value: str = "close", blocks: int | None = None, digits: int | None = None) -> DataFrame:
    """Pearson correlation of every pair over its common dates, tidied if `digits` are given."""
    return pair_corrs(series, value, blocks, digits)


def mean_abs_corr(corr: DataFrame) -> DataFrame:
    """Mean absolute correlation of each asset with the others."""
    pairs = full_matrix(corr.filter(F.col("asset_i") < F.col("asset_j")), "corr")
    return pairs.groupBy(F.col("asset_i").alias("symbol")).agg(F.avg(F.abs("corr")).alias("mean_abs_corr"))


def top_corr_assets(corr: DataFrame, n: int = 50) -> DataFrame:
    """Matrix restricted to the n assets with the highest mean absolute correlation."""
    best = mean_abs_corr(corr).orderBy(F.desc_nulls_last("mean_abs_corr"), "symbol").limit(n)
    a, b = best.select(F.col("symbol").alias("asset_i")), best.select(F.col("symbol").alias("asset_j"))
    return corr.join(a, "asset_i", "left_semi").join(b, "asset_j", "left_semi")


