"""Covariance shrunk towards equal variances without correlation, with the intensity of least expected error (Ledoit and Wolf, 2004)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.blocks import SQUARES, pair_moments
from candlewick.functions.guards import div
from candlewick.operators.dependence import complete_dates


def _parts(returns: DataFrame, value: str, blocks: int | None) -> DataFrame:
    """(asset_i, asset_j, n, s, q): covariance over n dates, and the mean product of squared deviations."""
    m = pair_moments(complete_dates(returns.filter(F.col(value).isNotNull())), value, blocks)
    # deviations are from each asset's mean over these very dates, so sums of products are moments about the mean
    return m.select("asset_i", "asset_j", "n", div("sxy", "n").alias("s"), div(SQUARES, "n").alias("q"))


def _intensity(parts: DataFrame) -> DataFrame:
    """One row (n, assets, target, intensity); every pair of different assets stands for two entries."""
    twice = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    own = F.when(F.col("asset_i") == F.col("asset_j"), F.col("s"))
    sums = parts.agg(F.max("n").alias("n"), F.count(own).alias("assets"), F.avg(own).alias("target"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"),
                     F.sum(twice * F.col("q")).alias("qq"))
    # squared distance of the sample matrix from its target, and how much of it is error of the sample
    apart = F.col("ss") - F.col("assets") * F.col("target") * F.col("target")
    error = (F.col("qq") - F.col("ss")) / F.col("n")
    share = F.when(apart > 0, F.greatest(F.least(error, apart), F.lit(0.0)) / apart).otherwise(1.0)
    return sums.select(F.col("n").cast("long").alias("n"), F.col("assets").cast("long").alias("assets"), "target", share.alias("intensity"))


def shrinkage_intensity(returns: DataFrame, value: str = "ret", blocks: int | None = None) -> DataFrame:
    """One row: dates, assets, mean variance of an asset and share of the target in the shrunk matrix. Without complete dates all but counts are null."""
    return _intensity(_parts(returns, value, blocks))


def shrunk_covariance(returns: DataFrame, value: str = "ret", year: float = 252.0, blocks: int | None = None) -> DataFrame:
    """Half-stored (asset_i, asset_j, cov), annual: (1 - intensity) of the covariance over complete dates, intensity of the mean variance on the diagonal."""
    parts = _parts(returns, value, blocks)
    one = _intensity(parts).select(F.struct("target", "intensity")).scalar()
    goal = F.when(F.col("asset_i") == F.col("asset_j"), one["target"]).otherwise(0.0)
    return parts.select("asset_i", "asset_j", (((1 - one["intensity"]) * F.col("s") + one["intensity"] * goal) * year).alias("cov"))
