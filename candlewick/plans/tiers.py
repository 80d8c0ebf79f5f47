"""Queries I1-I12: asset tiers over daily supplier bars with the asset dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.functions.windows import over
from candlewick.operators import cleaning as cl
from candlewick.operators import tiers as tr
from candlewick.plans.registry import register
from candlewick.plans.sqltext import ASSETS, SUPPLIER, ctes, lag, panel, rnd, roll, tidy
from candlewick.sources.market import assets, supplier_bars, table

# the synthetic prices swing far more than any market, so the entry filters are opened up
RULES = tr.TierRules(min_quality=0.3, max_volatility=5000.0, min_consistency=0.25)


def external(spark, d):
    """Caps and volumes; every sixth asset has no cap and takes the volume-only rule."""
    a = assets(spark, d)
    return a.select("symbol", F.when(F.col("symbol").cast("long") % 6 != 0, F.col("market_cap_usd")).alias("market_cap_usd"),
                    "daily_volume_brl")


def tiers_of(spark, d):
    return tr.tier_table(supplier_bars(spark, d), external(spark, d), RULES)


I = {  # noqa: E741
    "bars": SUPPLIER, "assets": ASSETS,
    "ix": f"SELECT *, close / nullif({lag('close')}, 0) - 1 AS r, {roll('avg', 'volume', 30)} AS v30, {roll('stddev_samp', 'volume', 30)} AS s30 FROM bars",
    "ia": """SELECT symbol, count(*) AS n, count(r) AS nr, stddev_samp(r) AS sd, arg_max(close, ts) AS close, arg_max(v30, ts) AS v30, arg_max(s30, ts) AS s30,
        sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT + (quote_volume IS NULL)::INT) AS nulls,
        count_if(abs(r) > 0.5) AS jumps, count_if(volume = 0) AS zero,
        count_if(high >= low AND high >= open AND high >= close AND low <= open AND low <= close) AS valid,
        count_if(volume > 0) AS nz, avg(volume) FILTER (volume > 0) AS mz, stddev_samp(volume) FILTER (volume > 0) AS sz FROM ix GROUP BY symbol""",
    "sc": """SELECT *, CASE WHEN n < 30 OR v30 = 0 THEN 0 ELSE least(greatest(0.6 * greatest(0, 1 - s30 / v30) + 0.4 * least(ln(1 + v30) / 20, 1), 0), 1) END AS liquidity_score,
        ((1 - nulls / (n * 6.0)) + greatest(0, 1 - 10.0 * jumps / nr) + greatest(0, 1 - 5.0 * zero / n) + valid / CAST(n AS DOUBLE)) / 4 AS data_quality_score,
        CASE WHEN n < 30 OR nz < 20 THEN 0 ELSE greatest(0, 1 - sz / mz) END AS volume_consistency FROM ia""",
    "metrics": """SELECT sc.symbol, sd * sqrt(252) AS volatility, coalesce(daily_volume_brl, close * v30) AS daily_volume,
        CASE WHEN CAST(symbol AS BIGINT) % 6 <> 0 THEN market_cap_usd END AS market_cap_usd, liquidity_score, data_quality_score, volume_consistency,
        n AS listing_age, close AS current_price, v30 AS avg_volume_30d FROM sc LEFT JOIN assets USING (symbol) WHERE n >= 90""",
    "why": """SELECT *, concat_ws(',', CASE WHEN data_quality_score < 0.3 THEN printf('data_quality_low_%.2f', data_quality_score) END,
        CASE WHEN volatility > 5000 THEN printf('volatility_too_high_%.1f', volatility) END,
        CASE WHEN volume_consistency < 0.25 THEN printf('volume_inconsistent_%.2f', volume_consistency) END) AS reasons FROM metrics""",
    "cls": """SELECT *, CASE WHEN reasons <> '' THEN 'excluded' WHEN market_cap_usd IS NOT NULL THEN CASE
          WHEN market_cap_usd BETWEEN 50e6 AND 400e6 AND daily_volume >= 100e3 THEN 'tier_1' WHEN market_cap_usd BETWEEN 20e6 AND 150e6 AND daily_volume >= 50e3 THEN 'tier_2'
          WHEN market_cap_usd BETWEEN 5e6 AND 50e6 AND daily_volume >= 25e3 THEN 'tier_3' ELSE 'excluded' END
        WHEN daily_volume >= 100e3 THEN 'tier_1' WHEN daily_volume >= 50e3 THEN 'tier_2' WHEN daily_volume >= 25e3 THEN 'tier_3' ELSE 'excluded' END AS tier0 FROM why""",
    "scored": """SELECT *, CASE WHEN tier0 = 'excluded' THEN 0 ELSE (least(daily_volume / (CASE tier0 WHEN 'tier_1' THEN 100e3 WHEN 'tier_2' THEN 50e3 ELSE 25e3 END), 5) / 5
          + liquidity_score + data_quality_score + CASE WHEN tier0 = 'tier_1' THEN greatest(0, 1 - volatility / 2) ELSE least(volatility / 2, 1) END) / 4 END AS tier_score,
        CASE WHEN tier0 = 'excluded' THEN 0 ELSE (1 + (market_cap_usd IS NOT NULL)::INT + (liquidity_score >= 0.5)::INT + (volume_consistency >= 0.25)::INT + (data_quality_score >= 0.3)::INT) / 5.0 END AS confidence FROM cls""",
    "rk": """SELECT *, CASE WHEN tier0 <> 'excluded' THEN row_number() OVER (PARTITION BY tier0 ORDER BY tier_score DESC, symbol) END AS k,
        CASE tier0 WHEN 'tier_1' THEN 8 WHEN 'tier_2' THEN 6 ELSE 4 END AS lim FROM scored""",
    "lim1": """SELECT *, CASE WHEN k <= lim THEN CAST(k AS INTEGER) END AS tier_rank, CASE WHEN k > lim THEN CASE tier0 WHEN 'tier_1' THEN 'tier_2' WHEN 'tier_2' THEN 'tier_3' ELSE 'excluded' END ELSE tier0 END AS tier,
        CASE WHEN k > lim AND tier0 = 'tier_3' THEN 'tier_limit_exceeded' ELSE reasons END AS why FROM rk""",
    "tiers": """SELECT *, CASE tier WHEN 'tier_1' THEN 0.5 WHEN 'tier_2' THEN 0.3 WHEN 'tier_3' THEN 0.15 ELSE 0 END / count(*) OVER (PARTITION BY tier) AS allocation_weight FROM lim1""",
}
METRICS = "volatility daily_volume liquidity_score data_quality_score volume_consistency"
register("I1_asset_metrics", lambda spark, d: rounded(tr.asset_metrics(supplier_bars(spark, d), external(spark, d), RULES), keep=("market_cap_usd", "current_price")), ctes(
    f"SELECT symbol, {rnd(METRICS)}, market_cap_usd, listing_age, current_price, {rnd('avg_volume_30d')} FROM metrics", **I))
for _n, _c in (("I2_liquidity_score", "liquidity_score"), ("I3_bar_quality_score", "data_quality_score"), ("I4_volume_consistency", "volume_consistency")):
    register(_n, lambda spark, d, c=_c: rounded(tr.asset_scores(supplier_bars(spark, d)).select("symbol", c)), ctes(f"SELECT symbol, {rnd(_c)} FROM sc", **I))


def _classified(spark, d):
    return tr.classify(tr.asset_metrics(supplier_bars(spark, d), external(spark, d), RULES), RULES)


register("I5_classify_tier", lambda spark, d: rounded(_classified(spark, d).select(
    "symbol", "tier", "tier_score", "confidence", F.concat_ws(",", "reasons").alias("reasons"))), ctes(
    f"SELECT symbol, tier0 AS tier, {rnd('tier_score confidence')}, reasons FROM scored", **I))


def _stable(spark, d):
    quote = F.when(F.col("s_suppkey") % 5 == 0, "-USDT").when(F.col("s_suppkey") % 7 == 0, "-dai").otherwise("-BRL")
    s = table(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), quote).alias("symbol"))
    return s.select("symbol", tr.is_stablecoin(F.col("symbol")).alias("is_stablecoin"))


register("I6_is_stablecoin", _stable, """SELECT symbol, regexp_matches(upper(symbol), 'USD|DAI|STABLE') AS is_stablecoin FROM (
    SELECT s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '-USDT' WHEN s_suppkey % 7 = 0 THEN '-dai' ELSE '-BRL' END AS symbol FROM supplier)""")
register("I7_tier_score", lambda spark, d: rounded(_classified(spark, d).filter("tier <> 'excluded'").select("symbol", "tier", "tier_score")), ctes(
    f"SELECT symbol, tier0 AS tier, {rnd('tier_score')} FROM scored WHERE tier0 <> 'excluded'", **I))
register("I8_apply_tier_limits", lambda spark, d: rounded(tr.apply_limits(_classified(spark, d), RULES).select(
    "symbol", "tier", "tier_rank", "tier_score", F.concat_ws(",", "reasons").alias("reasons"))), ctes(
    f"SELECT symbol, tier, tier_rank, {rnd('tier_score')}, why AS reasons FROM lim1", **I))
register("I9_allocation_weights", lambda spark, d: rounded(tiers_of(spark, d).select("symbol", "tier", "allocation_weight")), ctes(
    f"SELECT symbol, tier, {rnd('allocation_weight')} FROM tiers", **I))


def _history(spark, d):
    bars = cl.panel(supplier_bars(spark, d))
    daily = bars.select("symbol", "ts", tr.volume_tier(F.col("close") * over(bars).mean("volume", 30)).alias("tier")).filter("tier is not null")
    return tr.tier_history(daily).select("symbol", "tier", F.concat_ws(",", "history").alias("history"), "stability_days")


register("I10_tier_history", _history, ctes(
    """SELECT symbol, arg_max(tier, ts) AS tier, string_agg(tier, ',' ORDER BY ts) AS history,
    CASE WHEN count(*) >= 30 THEN count_if(tier = cur) ELSE 0 END AS stability_days FROM (SELECT *, first_value(tier) OVER (PARTITION BY symbol ORDER BY ts DESC) AS cur,
    row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM vt) WHERE back <= 30 GROUP BY symbol""", bars=panel(SUPPLIER),
    vt=f"""SELECT symbol, ts, CASE WHEN v >= 100e3 THEN 'tier_1' WHEN v >= 50e3 THEN 'tier_2' WHEN v >= 25e3 THEN 'tier_3' ELSE 'excluded' END AS tier FROM (
    SELECT symbol, ts, close * {roll('avg', 'volume', 30)} AS v FROM bars)"""))
register("I11_tier_summary", lambda spark, d: rounded(tr.tier_summary(tiers_of(spark, d)).select(
    "tier", "count", "total_allocation", "avg_tier_score", F.concat_ws(",", "ranked.symbol").alias("ranked"))), ctes(
    f"""SELECT tier, count(*) AS count, {tidy('sum(allocation_weight)')} AS total_allocation, {tidy('coalesce(avg(tier_score) FILTER (tier_score > 0), 0)')} AS avg_tier_score,
    coalesce(string_agg(symbol, ',' ORDER BY tier_rank, symbol) FILTER (tier_rank IS NOT NULL), '') AS ranked FROM tiers GROUP BY tier""", **I))
register("I12_normalised_allocation", lambda spark, d: rounded(tr.normalised_allocation(tiers_of(spark, d))), ctes(
    f"SELECT symbol, {tidy('allocation_weight / (SELECT sum(allocation_weight) FROM tiers)')} AS weight FROM tiers WHERE allocation_weight > 0", **I))
