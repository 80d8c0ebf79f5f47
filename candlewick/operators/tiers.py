"""Asset tiers: metrics per asset, tier rules, per-tier limits, allocation weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.guards import clip, div
from candlewick.functions.windows import over

TIERS = ("tier_1", "tier_2", "tier_3", "reserve", "excluded")


@dataclass(frozen=True)
class TierRules:
    """Bands per tier (cap low, cap high, volume floor, size limit, allocation) and the entry filters."""

    bands: tuple[tuple[float, float, float, int, float], ...] = (
        (50e6, 400e6, 100e3, 8, 0.50), (20e6, 150e6, 50e3, 6, 0.30), (5e6, 50e6, 25e3, 4, 0.15))
    reserve: float = 0.05
    min_age: int = 90
    min_quality: float = 0.7
    max_volatility: float = 3.0
    min_consistency: float = 0.5
    stable_window: int = 30


RULES = TierRules()


def is_stablecoin(symbol: Column) -> Column:
    # fixed values: markers of a pegged asset
    return F.upper(symbol).rlike("USD|USDT|USDC|BUSD|DAI|TUSD|STABLE")


def _tail_stats(bars: DataFrame) -> DataFrame:
    s = over(bars)
    c = F.col
    # of moving figures only the newest count: they are aggregates over the newest 30 rows, not a frame at every row
    rows = bars.withColumns({"_r": s.change("close"), "_v": F.when(s.newest(30), c("volume"))})
    whole = F.count("_v") == 30
    valid = (c("high") >= c("low")) & (c("high") >= c("open")) & (c("high") >= c("close")) & (c("low") <= c("open")) & (
        c("low") <= c("close"))
    some = c("volume") > 0
    values = ("open", "high", "low", "close", "volume", "quote_volume")
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("_r").alias("nr"), F.stddev_samp("_r").alias("sd"),
        F.struct(F.max_by("close", "ts").alias("close"), F.when(whole, F.avg("_v")).alias("_v30"), F.when(whole, F.stddev_samp("_v")).alias("_s30")).alias("l"),
        sum((F.count_if(c(v).isNull()) for v in values), F.lit(0)).alias("nulls"),
        F.count_if(F.coalesce(F.abs("_r") > 0.5, F.lit(False))).alias("jumps"), F.count_if(c("volume") == 0).alias("zero"),
        F.count_if(F.coalesce(valid, F.lit(False))).alias("valid"), F.count_if(some).alias("nz"),
        F.avg(F.when(some, c("volume"))).alias("mz"), F.stddev_samp(F.when(some, c("volume"))).alias("sz"))


def liquidity_score() -> Column:
    mean, sd = F.col("l._v30"), F.col("l._s30")
    score = 0.6 * F.greatest(F.lit(0.0), 1 - div(sd, mean)) + 0.4 * F.least(F.log1p(mean) / 20, F.lit(1.0))
    return F.when((F.col("n") < 30) | (mean == 0), 0.0).otherwise(clip(score, 0, 1))


def bar_quality_score() -> Column:
    n = F.col("n")
    jumps = F.greatest(F.lit(0.0), 1 - 10 * div("jumps", "nr"))
    zero = F.greatest(F.lit(0.0), 1 - 5 * F.col("zero") / n)
    whole, shape = 1 - F.col("nulls") / (n * 6), F.col("valid") / n
    return F.when(F.col("nr") > 0, (whole + jumps + zero + shape) / 4).otherwise((whole + shape) / 2)


def volume_consistency() -> Column:
    few = (F.col("n") < 30) | (F.col("nz") < 20) | (F.col("mz") == 0)
    return F.when(few, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - div("sz", "mz")))


def asset_scores(bars: DataFrame) -> DataFrame:
    """Liquidity, quality and volume consistency of every asset from one aggregate."""
    return _tail_stats(bars).select("symbol", liquidity_score().alias("liquidity_score"),
                                    bar_quality_score().alias("data_quality_score"),
                                    volume_consistency().alias("volume_consistency"))


def asset_metrics(bars: DataFrame, external: DataFrame, rules: TierRules = RULES) -> DataFrame:
    """Metrics of assets old enough; `external` gives (symbol, market_cap_usd, daily_volume_brl), both optional."""
    m = _tail_stats(bars).filter(F.col("n") >= rules.min_age)
    out = m.join(external.select("symbol", "market_cap_usd", "daily_volume_brl"), "symbol", "left")
    return out.select(
        "symbol", (F.col("sd") * 252 ** 0.5).alias("volatility"),
        F.coalesce("daily_volume_brl", F.col("l.close") * F.col("l._v30")).alias("daily_volume"), "market_cap_usd",
        liquidity_score().alias("liquidity_score"), bar_quality_score().alias("data_quality_score"),
        volume_consistency().alias("volume_consistency"), F.col("n").alias("listing_age"),
        F.col("l.close").alias("current_price"), F.col("l._v30").alias("avg_volume_30d"))


def volume_tier(volume: Column, rules: TierRules = RULES) -> Column:
    """Tier from daily volume alone."""
    out = F.when(volume >= rules.bands[0][2], TIERS[0])
    for name, band in zip(TIERS[1:3], rules.bands[1:]):
        out = out.when(volume >= band[2], name)
    return out.otherwise("excluded")


def _cap_tier(cap: Column, volume: Column, rules: TierRules) -> Column:
    fits = [(cap >= lo) & (cap <= hi) & (volume >= v) for lo, hi, v, _, _ in rules.bands]
    return F.when(fits[0], TIERS[0]).when(fits[1], TIERS[1]).when(fits[2], TIERS[2]).otherwise("excluded")


def tier_score(tier: Column, rules: TierRules = RULES) -> Column:
    floor = F.when(tier == "tier_1", rules.bands[0][2]).when(tier == "tier_2", rules.bands[1][2]).otherwise(rules.bands[2][2])
    volume = F.least(F.col("daily_volume") / floor, F.lit(5.0)) / 5
    half = F.col("volatility") / 2
    calm = F.when(tier == "tier_1", F.greatest(F.lit(0.0), 1 - half)).otherwise(F.least(half, F.lit(1.0)))
    return (volume + F.col("liquidity_score") + F.col("data_quality_score") + calm) / 4


def classify(metrics: DataFrame, rules: TierRules = RULES) -> DataFrame:
    """Tier, score, confidence and reasons of every asset, before size limits."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("listing_age") < rules.min_age, F.format_string("listing_age_too_short_%dd", "listing_age")),
        F.when(c("data_quality_score") < rules.min_quality, F.format_string("data_quality_low_%.2f", "data_quality_score")),
        F.when(c("volatility") > rules.max_volatility, F.format_string("volatility_too_high_%.1f", "volatility")),
        F.when(c("volume_consistency") < rules.min_consistency, F.format_string("volume_inconsistent_%.2f", "volume_consistency"))))
    stable = is_stablecoin(c("symbol"))
    out = metrics.withColumn("reasons", F.when(stable, F.array().cast("array<string>")).otherwise(reasons))
    open_tier = F.when(c("market_cap_usd").isNotNull(), _cap_tier(c("market_cap_usd"), c("daily_volume"), rules)).otherwise(
        volume_tier(c("daily_volume"), rules))
    out = out.withColumn("tier", F.when(stable, "reserve").when(F.size("reasons") > 0, "excluded").otherwise(open_tier))
    ranked = c("tier").isin(*TIERS[:3])
    met = (1 + c("market_cap_usd").isNotNull().cast("int") + (c("liquidity_score") >= 0.5).cast("int")
           + (c("volume_consistency") >= rules.min_consistency).cast("int") + (c("data_quality_score") >= rules.min_quality).cast("int"))
    return out.withColumns({"tier_score": F.when(ranked, tier_score(c("tier"), rules)).otherwise(0.0),
                            "confidence": F.when(c("tier") == "reserve", 0.9).when(ranked, met / 5.0).otherwise(0.0)})


def apply_limits(classified: DataFrame, rules: TierRules = RULES) -> DataFrame:
    """Rank each tier once and move the overflow one tier down; the lists are not formed again after that.

    Only the newest few of each tier need a rank, so the rank is cut per partition before the shuffle and the ranked
    side of the join has at most the sum of the limits. The classified table is one row per asset and read twice, so it is kept.
    """
    classified = classified.persist()
    limit = F.when(F.col("tier") == "tier_1", rules.bands[0][3]).when(F.col("tier") == "tier_2", rules.bands[1][3]).otherwise(
        rules.bands[2][3])
    w = Window.partitionBy("tier").orderBy(F.desc("tier_score"), "symbol")
    most = max(b[3] for b in rules.bands)
    best = (classified.filter(F.col("tier").isin(*TIERS[:3])).select("symbol", "tier", "tier_score")
            .withColumn("tier_rank", F.row_number().over(w)).filter(F.col("tier_rank") <= most)
            .filter(F.col("tier_rank") <= limit).select("symbol", "tier_rank"))
    out = classified.join(F.broadcast(best), "symbol", "left")
    over_limit = F.col("tier").isin(*TIERS[:3]) & F.col("tier_rank").isNull()
    down = F.when(F.col("tier") == "tier_1", "tier_2").when(F.col("tier") == "tier_2", "tier_3").otherwise("excluded")
    return out.withColumns({
        "reasons": F.when(over_limit & (F.col("tier") == "tier_3"), F.array_append("reasons", F.lit("tier_limit_exceeded"))).otherwise(
            F.col("reasons")),
        "tier": F.when(over_limit, down).otherwise(F.col("tier"))})


def allocation_weights(limited: DataFrame, rules: TierRules = RULES) -> DataFrame:
    """Equal split of each tier's target among its members; a fixed share for each reserve asset."""
    counts = limited.groupBy("tier").agg(F.count(F.lit(1)).alias("_k"))  # at most five rows
    target = F.create_map(*[x for t, b in zip(TIERS, rules.bands) for x in (F.lit(t), F.lit(b[4]))])
    out = limited.join(F.broadcast(counts), "tier")
    return out.withColumn("allocation_weight", F.when(F.col("tier").isin(*TIERS[:3]), target[F.col("tier")] / F.col("_k")).when(
        F.col("tier") == "reserve", rules.reserve).otherwise(0.0)).drop("_k")


def tier_table(bars: DataFrame, external: DataFrame, rules: TierRules = RULES) -> DataFrame:
    """Metrics to weights."""
    return allocation_weights(apply_limits(classify(asset_metrics(bars, external, rules), rules), rules), rules)


def tier_history(daily: DataFrame, keep: int = 90, window: int = 30) -> DataFrame:
    """From (symbol, ts, tier): current tier, the newest `window` tiers, and how many of them equal the current one."""
    tail = daily.withColumn("_back", over(daily).from_last()).filter(F.col("_back") <= min(keep, window))
    agg = tail.groupBy("symbol").agg(F.max_by("tier", "ts").alias("tier"),
                                     F.array_sort(F.collect_list(F.struct("ts", "tier"))).alias("h"))
    same = F.size(F.filter("h.tier", lambda t: t == F.col("tier")))
    return agg.select("symbol", "tier", F.col("h.tier").alias("history"),
                      F.when(F.size("h") >= window, same).otherwise(0).alias("stability_days"))


def tier_summary(table: DataFrame) -> DataFrame:
    """Per tier: members, allocation, mean positive score, and the best-ranked members (ranks are bounded by the limits)."""
    return table.groupBy("tier").agg(
        F.count(F.lit(1)).alias("count"), F.sum("allocation_weight").alias("total_allocation"),
        F.coalesce(F.avg(F.when(F.col("tier_score") > 0, F.col("tier_score"))), F.lit(0.0)).alias("avg_tier_score"),
        F.array_sort(F.collect_list(F.when(F.col("tier_rank").isNotNull(), F.struct("tier_rank", "symbol")))).alias("ranked"))


def normalised_allocation(table: DataFrame) -> DataFrame:
    held = table.filter(F.col("allocation_weight") > 0).select("symbol", "allocation_weight")
    total = held.agg(F.sum("allocation_weight"))
    return held.select("symbol", div("allocation_weight", total.scalar()).alias("weight"))
