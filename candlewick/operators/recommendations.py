"""Integrated recommendations: weights from scores and tiers, regime adjustment, outlook, opportunities, risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.guards import div

LIMITS = {"tier_1": 8, "tier_2": 6, "tier_3": 4}


def recommended_weights(scores: DataFrame, tiers: DataFrame, min_score: float = 0.3, total: float = 0.95) -> DataFrame:
    """Best-scored assets of each tier, weighted by score inside the tier's allocation, scaled to `total`.

    After the per-tier cut (applied before the shuffle) at most 18 rows remain, so the later windows are tiny.
    """
    fit = scores.select("symbol", "composite_score").join(
        tiers.filter(F.col("tier").isin(*LIMITS)).select("symbol", "tier", "allocation_weight"), "symbol").filter(
        F.col("composite_score") >= min_score)
    w = Window.partitionBy("tier").orderBy(F.desc("composite_score"), "symbol")
    limit = F.when(F.col("tier") == "tier_1", 8).when(F.col("tier") == "tier_2", 6).otherwise(4)
    best = fit.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 8).filter(F.col("_k") <= limit)
    tier = Window.partitionBy("tier")
    out = best.withColumns({
        "_alloc": F.first("allocation_weight").over(w) * F.count(F.lit(1)).over(tier),
        "_share": F.coalesce(div("composite_score", F.sum("composite_score").over(tier)), 1 / F.count(F.lit(1)).over(tier))})
    out = out.withColumn("_w", F.col("_alloc") * F.col("_share"))
    return out.select("symbol", "tier", "composite_score",
                      (F.col("_w") * div(F.lit(total), F.sum("_w").over(Window.partitionBy()))).alias("weight"))


def tier_members(tiers: DataFrame) -> DataFrame:
    """Ranked members of each tier by rank, then the number of unranked ones; the list is bounded by the tier limits."""
    ranked = F.array_sort(F.collect_list(F.when(F.col("tier_rank").isNotNull(), F.struct("tier_rank", "symbol"))))
    return tiers.filter(F.col("tier") != "excluded").groupBy("tier").agg(
        ranked.getField("symbol").alias("ranked"), F.count_if(F.col("tier_rank").isNull()).alias("unranked"))


def tier_order(tiers: DataFrame) -> DataFrame:
    """Every member with its tier and sort key (unranked last), as rows."""
    return tiers.filter(F.col("tier") != "excluded").select("tier", "symbol", F.coalesce("tier_rank", F.lit(999)).alias("order"))


def regime_adjusted(weights: DataFrame, regime: DataFrame) -> DataFrame:
    """Weights times 0.95 in a bull, bear or volatile market; `regime` is one row."""
    now = regime.select("regime").scalar()
    return weights.withColumn("weight", F.col("weight") * F.when(now.isin("bull", "bear", "volatile"), 0.95).otherwise(1.0))


def _top(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("composite_score"), "symbol").limit(n)


def market_outlook(regime: DataFrame, scores: DataFrame, signals: DataFrame) -> DataFrame:
    """One sentence from one-row summaries; only the five best symbols are listed."""
    names = _top(scores, 5).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("composite_score")).alias("s"), "symbol"))), lambda x: x["symbol"])))
    mean = scores.agg(F.avg("composite_score"))
    count = signals.agg(F.count_if(F.col("direction") == "bullish").alias("b"), F.count_if(F.col("direction") == "bearish").alias("e"))
    pair = count.select(F.struct("b", "e")).scalar()
    return regime.select(F.format_string(
        "Market regime: %s (confidence: %.1f%%). Average asset score: %.3f. Top opportunities: %s. Signal sentiment: %d bullish, %d bearish.",
        F.upper("regime"), F.col("confidence") * 100, mean.scalar(), names.scalar(), pair["b"], pair["e"]).alias("outlook"))


def opportunities(scores: DataFrame, signals: DataFrame, high: float = 0.7, sure: float = 0.7) -> DataFrame:
    """First the top three scores above `high`, then assets with confident bullish signals; five rows at most."""
    best = _top(scores, 3).filter(F.col("composite_score") > high).select(
        F.lit(1).alias("kind"), "symbol", F.col("composite_score").alias("value"))
    bullish = signals.filter((F.col("direction") == "bullish") & (F.col("confidence") > sure)).groupBy("symbol").agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(2).alias("kind"), "symbol", "value")
    return best.unionByName(bullish).orderBy("kind", F.when(F.col("kind") == 1, -F.col("value")), "symbol").limit(5)


def risk_alerts(regime: DataFrame, tiers: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows of raised flags, five at most."""
    r = regime.select(F.explode(F.array_compact(F.array(
        F.when(F.col("regime").isin("bear", "volatile"), F.concat(F.lit("regime risk: "), "regime")),
        F.when(F.col("volatility_signal") > 0.8, "high volatility")))).alias("risk"))
    t = tiers.agg(F.count_if(F.col("tier") == "excluded").alias("x"), F.count(F.lit(1)).alias("n")).filter(
        F.col("x") > F.col("n") * 0.5).select(F.format_string("many assets excluded (%d)", "x").alias("risk"))
    s = signals.agg(F.count_if((F.col("direction") == "bearish") & (F.col("confidence") > 0.6)).alias("k")).filter(
        F.col("k") > 5).select(F.format_string("strong bearish signals (%d)", "k").alias("risk"))
    return r.unionByName(t).unionByName(s).limit(5)


def intelligence_stats(scores: DataFrame, tiers: DataFrame, signals: DataFrame, weights: DataFrame) -> DataFrame:
    """One row of counts over the four result tables."""
    tier = tiers.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("tier_1", "tier_2", "tier_3", "reserve", "excluded")])
    one = lambda df: df.select(F.struct(*df.columns)).scalar()
    t = one(tier)
    s = one(signals.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("a")))
    w = one(weights.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("a")))
    return scores.agg(F.count(F.lit(1)).alias("assets_scored"), F.avg("composite_score").alias("avg_composite_score")).select(
        "*", *[t[k].alias(k) for k in ("tier_1", "tier_2", "tier_3", "reserve", "excluded")],
        s["n"].alias("total_signals"), s["a"].alias("assets_with_signals"), w["n"].alias("portfolio_assets"),
        w["a"].alias("total_allocation"))


def top_positions(weights: DataFrame, n: int = 10) -> DataFrame:
    return weights.orderBy(F.desc("weight"), "symbol").limit(n).select("symbol", "weight")
