"""Portfolio construction on long matrices: (symbol, weight), (symbol, mu) and half-stored (asset_i, asset_j, cov)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.guards import div
from candlewick.functions.windows import over
from candlewick.operators.dependence import complete_dates, cov_matrix, full_matrix

TIER_BOUNDS = {"tier_1": (0.45, 0.55), "tier_2": (0.25, 0.35), "tier_3": (0.10, 0.20)}


def expected_returns(weights: DataFrame, min_assets: int = 8, scale: float = 0.4) -> DataFrame:
    """(symbol, tier, mu) of recommended assets; empty below `min_assets`."""
    n = weights.agg(F.count(F.lit(1)))
    return weights.filter(n.scalar() >= min_assets).select(
        "symbol", "tier", ((F.col("composite_score") - 0.5) * scale).alias("mu"))


def recent_covariance(bars: DataFrame, symbols: DataFrame, n: int = 252, min_rows: int = 60, year: float = 252.0) -> DataFrame:
    """Annual covariance over the dates shared by the newest n returns of every listed asset."""
    mine = bars.join(symbols.select("symbol"), "symbol", "left_semi")
    s = over(mine)
    tail = mine.withColumns({"ret": s.change("close"), "_b": s.from_last()}).filter(
        (F.col("_b") <= n) & F.col("ret").isNotNull()).select("symbol", "ts", "ret")
    return cov_matrix(complete_dates(tail), "ret", min_rows - 1, year)


def mean_returns(returns: DataFrame, value: str = "ret", year: float = 252.0) -> DataFrame:
    return returns.groupBy("symbol").agg((F.avg(value) * year).alias("mu"))


def variance(weights: DataFrame, cov: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """w' C w per group from the half-stored matrix: off-diagonal terms count twice."""
    a = weights.select(*by, F.col("symbol").alias("asset_i"), F.col("weight").alias("_wi"))
    b = weights.select(*by, F.col("symbol").alias("asset_j"), F.col("weight").alias("_wj"))
    twice = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    joined = cov.join(a, "asset_i").join(b, [*by, "asset_j"])
    term = F.sum(F.col("_wi") * F.col("_wj") * F.col("cov") * twice).alias("variance")
    return joined.groupBy(*by).agg(term) if by else joined.agg(term)


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame, rate: float = 0.10, by: tuple[str, ...] = ()) -> DataFrame:
    """Return, volatility and Sharpe ratio of each portfolio (`by` names its key columns)."""
    gain = weights.join(mu.select("symbol", "mu"), "symbol")
    value = F.sum(F.col("weight") * F.col("mu")).alias("ret")
    var = variance(weights, cov, by)
    both = gain.groupBy(*by).agg(value).join(var, list(by)) if by else gain.agg(value).withColumn("variance", var.scalar())
    vol = F.sqrt("variance")
    return both.select(*by, "ret", vol.alias("volatility"), div(F.col("ret") - rate, vol).alias("sharpe"))


def _matrix(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(frame["asset_i"]) | set(frame["asset_j"]))
    at = {n: k for k, n in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    i, j = frame["asset_i"].map(at).to_numpy(), frame["asset_j"].map(at).to_numpy()
    c[i, j] = frame["cov"]
    c[j, i] = frame["cov"]
    return names, c


def _solve(frame: pd.DataFrame, rate: float) -> pd.DataFrame:
    """Closed-form weights and the four scalars of the frontier for one universe."""
    names, c = _matrix(frame)
    mu = frame.drop_duplicates("asset_i").set_index("asset_i")["mu_i"].reindex(names).to_numpy()
    ones = np.ones(len(names))
    u, v = np.linalg.solve(c, ones), np.linalg.solve(c, mu)
    excess = v - rate * u
    return pd.DataFrame({
        "universe": frame["universe"].iat[0], "symbol": names, "min_variance": u / u.sum(), "max_sharpe": excess / excess.sum(),
        "a": ones @ u, "b": mu @ u, "c": mu @ v})


def closed_form(mu: DataFrame, cov: DataFrame, rate: float = 0.0, universe: str | None = None) -> DataFrame:
    """Minimum-variance and maximum-Sharpe weights per universe, with the frontier scalars a, b, c.

    The matrix is built by Spark; one task solves one universe, which is an investable list, so its matrix is small; many universes run in parallel.
    universe: the column of cov that names it.
    """
    keyed = cov.withColumn("universe", F.lit("all")) if universe is None else cov.withColumnRenamed(universe, "universe")
    whole = keyed.join(mu.select(F.col("symbol").alias("asset_i"), F.col("mu").alias("mu_i")), "asset_i")
    schema = "universe string, symbol string, min_variance double, max_sharpe double, a double, b double, c double"
    return whole.groupBy("universe").applyInPandas(lambda f: _solve(f, rate), schema)


def efficient_frontier(solution: DataFrame, low: float, high: float, steps: int = 50) -> DataFrame:
    """Lowest risk for each target return, from the frontier scalars."""
    one = solution.groupBy("universe").agg(*[F.first(k).alias(k) for k in ("a", "b", "c")])
    grid = one.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    t = F.lit(low) + F.col("step") * ((high - low) / steps)
    d = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return grid.select("universe", "step", t.alias("target"), F.sqrt(div(
        F.col("a") * t * t - 2 * F.col("b") * t + F.col("c"), d)).alias("risk"))


def capital_market_line(points: DataFrame, market: DataFrame, rate: float = 0.2, mu: str = "mu") -> DataFrame:
    """Risk needed on the line through (0, rate) and the market portfolio; `market` is one row (ret, volatility)."""
    m = market.select(F.struct("ret", "volatility")).scalar()
    return points.withColumn("line_risk", m["volatility"] * div(F.col(mu) - rate, m["ret"] - rate))


def random_weights(spark: SparkSession, symbols: DataFrame, n: int, a: int = 7919, b: int = 104729, m: int = 9973) -> DataFrame:
    """n long-only portfolios with integer-hashed weights summing to 1: (id, symbol, weight). `symbols` is one universe."""
    listed = symbols.select("symbol").distinct().agg(F.array_sort(F.collect_list("symbol")).alias("l"))
    rows = spark.range(n).select("id", F.posexplode(listed.scalar()).alias("k", "symbol"))
    x = F.col("id") + 1
    raw = F.pmod(x * a + (F.col("k") + 1) * b + x * (F.col("k") + 1) * 31, F.lit(m)).cast("double") + 1
    whole = rows.withColumn("raw", raw)
    total = whole.groupBy("id").agg(F.sum("raw").alias("_t"))
    return whole.join(total, "id").select("id", "symbol", (F.col("raw") / F.col("_t")).alias("weight"))


def random_portfolios(spark: SparkSession, mu: DataFrame, cov: DataFrame, n: int = 10_000, rate: float = 0.0) -> DataFrame:
    return portfolio_stats(random_weights(spark, mu, n), mu, cov, rate, by=("id",))


def best_of(stats: DataFrame) -> DataFrame:
    """Lowest-risk and highest-Sharpe candidate."""
    row = F.struct("id", "ret", "volatility", "sharpe")
    pick = stats.agg(F.min_by(row, F.struct("volatility", "id")).alias("low"), F.max_by(row, F.struct("sharpe", -F.col("id"))).alias("top"))
    return pick.select(F.explode(F.array(
        F.struct(F.lit("min_risk").alias("kind"), F.col("low").alias("r")),
        F.struct(F.lit("max_sharpe").alias("kind"), F.col("top").alias("r")))).alias("x")).select("x.kind", "x.r.*")


def bounded_best(spark: SparkSession, mu: DataFrame, cov: DataFrame, low: float, high: float, n: int = 10_000, rate: float = 0.10,
                 target: float | None = None) -> DataFrame:
    """Weights of the best candidate inside the box: highest Sharpe, or lowest variance at or above a target return."""
    w = random_weights(spark, mu, n)
    inside = w.groupBy("id").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).filter(
        (F.col("lo") >= low) & (F.col("hi") <= high)).select("id")
    stats = portfolio_stats(w.join(inside, "id", "left_semi"), mu, cov, rate, by=("id",))
    if target is not None:
        stats = stats.filter(F.col("ret") >= target)
        best = stats.agg(F.min_by("id", F.struct("volatility", "id")).alias("id"))
    else:
        best = stats.agg(F.max_by("id", F.struct("sharpe", -F.col("id"))).alias("id"))
    return w.filter(F.col("id") == best.scalar())


def inverse_vol_weights(vols: DataFrame) -> DataFrame:
    """1 / volatility scaled to 1."""
    inv = vols.select("symbol", div(F.lit(1.0), "volatility").alias("_i"))
    total = inv.agg(F.sum("_i"))
    return inv.select("symbol", div("_i", total.scalar()).alias("weight"))


def equal_weights(symbols: DataFrame) -> DataFrame:
    n = symbols.agg(F.count(F.lit(1)))
    return symbols.select("symbol", (F.lit(1.0) / n.scalar()).alias("weight"))


def apply_bounds(weights: DataFrame, low: float = 0.005, high: float = 0.05, total: float = 0.95) -> DataFrame:
    """Clip weights, pull each tier's sum to the edge of its band, rescale; (symbol, tier, weight) in and out."""
    cut = weights.withColumn("weight", F.greatest(F.least("weight", F.lit(high)), F.lit(low)))
    sums = cut.groupBy("tier").agg(F.sum("weight").alias("_s"))  # one row per tier
    lo = F.create_map(*[x for t, b in TIER_BOUNDS.items() for x in (F.lit(t), F.lit(b[0]))])[F.col("tier")]
    hi = F.create_map(*[x for t, b in TIER_BOUNDS.items() for x in (F.lit(t), F.lit(b[1]))])[F.col("tier")]
    factor = F.when(F.col("_s") > hi, hi / F.col("_s")).when((F.col("_s") < lo) & (F.col("_s") > 0), lo / F.col("_s")).otherwise(1.0)
    scaled = cut.join(F.broadcast(sums.withColumn("_f", factor).select("tier", "_f")), "tier").withColumn(
        "weight", F.col("weight") * F.col("_f")).drop("_f")
    whole = scaled.agg(F.sum("weight"))
    return scaled.withColumn("weight", F.col("weight") * div(F.lit(total), whole.scalar()))


def rebalance_actions(target: DataFrame, current: DataFrame, drift: float = 0.25, smallest: float = 0.001) -> DataFrame:
    """BUY or SELL rows where the change exceeds the drift band and the smallest trade."""
    both = target.select("symbol", F.col("weight").alias("target_weight")).join(
        current.select("symbol", F.col("weight").alias("current_weight")), "symbol", "left").fillna(0.0, ["current_weight"])
    diff = F.col("target_weight") - F.col("current_weight")
    return both.withColumn("change", diff).filter(
        (F.abs("change") > drift * F.col("current_weight")) & (F.abs("change") > smallest)).withColumn(
            "action", F.when(F.col("change") > 0, "BUY").otherwise("SELL"))


def tier_allocation(weights: DataFrame, reserve: float = 0.05) -> DataFrame:
    """Weight per tier, with the reserve as its own row."""
    sums = weights.groupBy("tier").agg(F.sum("weight").alias("weight"))
    extra = sums.agg(F.lit("reserve").alias("tier"), F.lit(reserve).alias("weight"))
    return sums.unionByName(extra)


def parametric_risk(stats: DataFrame) -> DataFrame:
    """Normal value at risk at 5 %, the return-based form, and the rough drawdown estimate."""
    # fixed value: 5 % normal quantile
    return stats.select("*", (F.abs(F.lit(1.6448536269514722)) * F.col("volatility")).alias("var_95"),
                        (F.col("ret") - 1.645 * F.col("volatility")).alias("return_var_95"),
                        (2.5 * F.col("volatility")).alias("drawdown_estimate"))


def diversification(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Weighted mean volatility over portfolio volatility."""
    own = cov.filter(F.col("asset_i") == F.col("asset_j")).select(F.col("asset_i").alias("symbol"), F.sqrt("cov").alias("_v"))
    mean = weights.join(own, "symbol").agg(F.sum(F.col("weight") * F.col("_v")).alias("m"))
    return mean.select(F.coalesce(div("m", F.sqrt(variance(weights, cov).scalar())), F.lit(1.0)).alias("diversification_ratio"))


def risk_contribution(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Share of portfolio risk of each asset."""
    w = weights.select(F.col("symbol").alias("asset_j"), F.col("weight").alias("_wj"))
    pull = full_matrix(cov, "cov").join(w, "asset_j").groupBy(F.col("asset_i").alias("symbol")).agg(
        F.sum(F.col("_wj") * F.col("cov")).alias("_p"))
    part = weights.join(pull, "symbol").withColumn("_r", F.col("weight") * F.col("_p"))
    total = part.agg(F.sum("_r"))
    return part.select("symbol", "weight", div("_r", total.scalar()).alias("risk_share"))


def portfolio_series(returns: DataFrame, weights: DataFrame, value: str = "ret") -> DataFrame:
    """Weighted return per date and its running sum. One row per date after the aggregate."""
    day = returns.join(weights.select("symbol", "weight"), "symbol").groupBy("ts").agg(
        F.sum(F.col(value) * F.col("weight")).alias("portfolio_return")).withColumn("symbol", F.lit("portfolio"))
    return day.withColumn("cumulative", F.sum("portfolio_return").over(over(day).running)).drop("symbol")
