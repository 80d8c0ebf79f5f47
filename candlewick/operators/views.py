"""Black-Litterman: expected returns that the market's weights imply, moved by stated views in proportion to how sure these are.

All sums over assets are joins and aggregates on (universe, asset); a universe's own work in a task is an equation system in its views, which are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _whole(cov: DataFrame) -> DataFrame:
    """Both triangles of (universe, asset_i, asset_j, cov)."""
    mirrored = cov.filter("asset_i < asset_j").select("universe", F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), "cov")
    return cov.select("universe", "asset_i", "asset_j", "cov").unionByName(mirrored)


def implied_returns(weights: DataFrame, cov: DataFrame, aversion: float = 2.5) -> DataFrame:
    """(universe, symbol, prior): aversion times covariance times market weights (universe, symbol, weight)."""
    held = weights.select("universe", F.col("symbol").alias("asset_j"), "weight")
    return _whole(cov).join(held, ["universe", "asset_j"]).groupBy("universe", F.col("asset_i").alias("symbol")).agg(
        (aversion * F.sum(F.col("cov") * F.col("weight"))).alias("prior"))


def posterior_returns(prior: DataFrame, cov: DataFrame, views: DataFrame, tau: float = 0.05) -> DataFrame:
    """(universe, symbol, prior, posterior) for each row of prior (universe, symbol, prior).

    views: (universe, view, symbol, share, outlook, doubt), a row per asset of a view: the portfolio of shares is expected to return `outlook`
    with a variance of `doubt`, the same on all rows of a view; 0 is a sure view, which the posterior meets. Assets of a view that the universe
    does not have are left out. Without views the posterior is the prior. Views that repeat each other are taken together by least squares.
    """
    known = views.join(prior.select("universe", "symbol", "prior"), ["universe", "symbol"])
    loads = _whole(cov).join(known.select("universe", "view", F.col("symbol").alias("asset_i"), "share"), ["universe", "asset_i"]).groupBy(
        "universe", "view", F.col("asset_j").alias("symbol")).agg((tau * F.sum(F.col("share") * F.col("cov"))).alias("load"))
    other = known.select("universe", F.col("view").alias("other"), "symbol", F.col("share").alias("share_o"))
    cross = loads.join(other, ["universe", "symbol"]).groupBy("universe", "view", "other").agg(F.sum(F.col("load") * F.col("share_o")).alias("c"))
    # a view without an asset that moves has no place in the system
    gaps = known.groupBy("universe", "view").agg((F.max("outlook") - F.sum(F.col("share") * F.col("prior"))).alias("gap"), F.max("doubt").alias("doubt"))

    def pulls(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(frame["view"])
        at = {v: k for k, v in enumerate(names)}
        own = frame.drop_duplicates("view").set_index("view").loc[names]
        m = np.diag(own["doubt"].to_numpy(float))
        m[frame["view"].map(at), frame["other"].map(at)] += frame["c"].to_numpy(float)
        pull = np.linalg.lstsq(m, own["gap"].to_numpy(float), rcond=None)[0]
        return pd.DataFrame({"universe": frame["universe"].iat[0], "view": names, "pull": pull})

    kinds = dict(views.dtypes)
    pulled = cross.join(gaps, ["universe", "view"]).groupBy("universe").applyInPandas(pulls, f"universe {kinds['universe']}, view {kinds['view']}, pull double")
    moved = loads.join(pulled, ["universe", "view"]).groupBy("universe", "symbol").agg(F.sum(F.col("load") * F.col("pull")).alias("move"))
    return prior.join(moved, ["universe", "symbol"], "left").select("universe", "symbol", "prior", (F.col("prior") + F.coalesce("move", F.lit(0.0))).alias("posterior"))
