"""Stress suite: what scenarios do to the variance, value at risk and drawdown of portfolios.

A scenario gives a price shock by exposure group, a factor on volatilities, a level that correlations are forced towards and how far, and a factor on
liquidity. Forcing is a mean of the matrix with one of equal correlations, both valid matrices, so the result is one as well and no entry is
repaired by hand. With it the stressed variance is a mean of two quadratic forms, each one aggregate over portfolios and assets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.guards import div

# fixed values: the suite as stated: benchmark -20 % overnight, liquidity halved, correlations to 0.9; and all at once
SUITE = [("benchmark_fall", -0.20, 1.0, 0.0, 0.0, 1.0), ("liquidity_halved", 0.0, 1.0, 0.0, 0.0, 0.5), ("correlation_spike", 0.0, 1.0, 0.9, 1.0, 1.0),
         ("all_together", -0.20, 1.5, 0.9, 1.0, 0.5)]
FORM = "scenario string, shock double, volatility double, level double, force double, liquidity double"


def suite(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUITE, FORM)


def stress(weights: DataFrame, cov: DataFrame, exposures: DataFrame, scenarios: DataFrame, quantile: float = 1.6448536269514722, days_to_sell: float = 1.0) -> DataFrame:
    """One row per portfolio and scenario: volatility, value at risk and drawdown estimate before and after, the loss of the shock, days to sell.

    weights: (portfolio, symbol, weight); cov: half-stored (asset_i, asset_j, cov); exposures: (symbol, beta), the share of the benchmark's
    shock that an asset takes, 1 where it is missing. level is from 0 to 1, force from 0, no change, to 1, all correlations at the level. Value at
    risk is quantile times volatility, drawdown two and a half times volatility, both with the shock's loss on top. Scenarios are few rows.
    """
    own = cov.filter("asset_i = asset_j").select(F.col("asset_i").alias("symbol"), F.sqrt("cov").alias("vol"))
    held = weights.join(own, "symbol").join(exposures.select("symbol", "beta"), "symbol", "left")
    # with equal correlations the variance is (1 - level) sum (w s)^2 + level (sum w s)^2
    flat = held.groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("vol")).alias("sum_vol"), F.sum(F.pow(F.col("weight") * F.col("vol"), F.lit(2.0))).alias("sum_square"),
                                         F.sum(F.col("weight") * F.coalesce("beta", F.lit(1.0))).alias("beta"))
    one = weights.select("portfolio", F.col("symbol").alias("asset_i"), F.col("weight").alias("wi"))
    other = weights.select("portfolio", F.col("symbol").alias("asset_j"), F.col("weight").alias("wj"))
    twice = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    form = one.join(cov, "asset_i").join(other, ["portfolio", "asset_j"]).groupBy("portfolio").agg(F.sum(twice * F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))
    listed = scenarios.agg(F.collect_list(F.struct(*[c.split()[0] for c in FORM.split(", ")])).alias("s"))
    each = flat.join(form, "portfolio").withColumn("x", F.explode(listed.scalar())).select("*", "x.*").drop("x")
    equal = (1 - F.col("level")) * F.col("sum_square") + F.col("level") * F.col("sum_vol") * F.col("sum_vol")
    after = F.col("volatility") * F.col("volatility") * ((1 - F.col("force")) * F.col("variance") + F.col("force") * equal)
    loss = F.greatest(-F.col("shock") * F.col("beta"), F.lit(0.0))
    base, hit = F.sqrt("variance"), F.sqrt(F.greatest(after, F.lit(0.0)))
    return each.select("portfolio", "scenario", base.alias("volatility_before"), hit.alias("volatility_after"), div(after, "variance").alias("variance_ratio"), loss.alias("shock_loss"),
                       (quantile * base).alias("var_before"), (quantile * hit + loss).alias("var_after"), (2.5 * base).alias("drawdown_before"),
                       F.least(2.5 * hit + loss, F.lit(1.0)).alias("drawdown_after"), div(F.lit(days_to_sell), "liquidity").alias("days_to_sell"))


def forced_correlations(corr: DataFrame, level: float = 0.9, force: float = 1.0) -> DataFrame:
    """Half-stored (asset_i, asset_j, corr) moved towards equal correlations; a valid matrix stays one."""
    goal = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(level)
    return corr.select("asset_i", "asset_j", ((1 - force) * F.col("corr") + force * goal).alias("corr"))
