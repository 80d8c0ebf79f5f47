"""Queries K1-K7: recommendations from scores (weekly panel), tiers, signals and the benchmark regime (daily bars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import recommendations as rc
from candlewick.operators import regimes as rg
from candlewick.plans.regimes import LATEST, REG
from candlewick.plans.registry import register
from candlewick.plans.scoring import H, scores_of
from candlewick.plans.signals import BENCH, J, signals_of
from candlewick.plans.sqltext import SUPPLIER, ctes, rnd, tidy
from candlewick.plans.tiers import I, tiers_of
from candlewick.sources.market import supplier_bars

MIN = 0.3


def regime_of(spark, d):
    return rg.detect(supplier_bars(spark, d).filter(F.col("symbol") == BENCH))


def weights_of(spark, d):
    return rc.recommended_weights(scores_of(spark, d), tiers_of(spark, d), MIN)


K = {
    "scores": ctes("SELECT * FROM scores", **H),
    "tiers": ctes("SELECT * FROM tiers", **I),
    "signals": ctes("SELECT * FROM signals", **J),
    "regime": ctes(f"SELECT reg.* FROM reg JOIN lst USING (symbol, ts) WHERE reg.symbol = '{BENCH}'", bars=SUPPLIER, **REG, lst=LATEST["lst"]),
    "fit": f"""SELECT symbol, tier, composite_score, allocation_weight, row_number() OVER (PARTITION BY tier ORDER BY composite_score DESC, symbol) AS k
        FROM scores JOIN tiers USING (symbol) WHERE tier IN ('tier_1', 'tier_2', 'tier_3') AND composite_score >= {MIN}""",
    "best": "SELECT * FROM fit WHERE k <= CASE tier WHEN 'tier_1' THEN 8 WHEN 'tier_2' THEN 6 ELSE 4 END",
    "wt": """SELECT symbol, tier, composite_score, first_value(allocation_weight) OVER (PARTITION BY tier ORDER BY k) * count(*) OVER (PARTITION BY tier)
        * composite_score / sum(composite_score) OVER (PARTITION BY tier) AS w FROM best""",
    "weights": "SELECT symbol, tier, composite_score, w * 0.95 / sum(w) OVER () AS weight FROM wt",
}


def parts(*names: str) -> dict[str, str]:
    return {n: K[n] for n in names}


WT = ("scores", "tiers", "fit", "best", "wt", "weights")
register("K1_recommended_weights", lambda spark, d: rounded(weights_of(spark, d)), ctes(
    f"SELECT symbol, tier, {rnd('composite_score weight')} FROM weights", **parts(*WT)))
register("K2_tier_members", lambda spark, d: rc.tier_members(tiers_of(spark, d)).select(
    "tier", F.concat_ws(",", "ranked").alias("ranked"), "unranked"), ctes(
    """SELECT tier, coalesce(string_agg(symbol, ',' ORDER BY tier_rank, symbol) FILTER (tier_rank IS NOT NULL), '') AS ranked, count_if(tier_rank IS NULL) AS unranked
    FROM tiers WHERE tier <> 'excluded' GROUP BY tier""", **I))
register("K2_tier_order", lambda spark, d: rc.tier_order(tiers_of(spark, d)), ctes(
    """SELECT tier, symbol, coalesce(tier_rank, 999) AS "order" FROM tiers WHERE tier <> 'excluded'""", **I))
register("K3_regime_adjusted_weights", lambda spark, d: rounded(rc.regime_adjusted(weights_of(spark, d), regime_of(spark, d)).select("symbol", "weight")), ctes(
    f"SELECT symbol, {tidy('''weight * CASE WHEN (SELECT regime FROM regime) IN ('bull', 'bear', 'volatile') THEN 0.95 ELSE 1.0 END''')} AS weight FROM weights",
    **parts(*WT, "regime")))
register("K4_market_outlook", lambda spark, d: rc.market_outlook(regime_of(spark, d), scores_of(spark, d), signals_of(spark, d)), ctes(
    """SELECT printf('Market regime: %s (confidence: %.1f%%). Average asset score: %.3f. Top opportunities: %s. Signal sentiment: %d bullish, %d bearish.',
    upper(regime), confidence * 100.0, (SELECT avg(composite_score) FROM scores),
    (SELECT string_agg(symbol, ', ' ORDER BY composite_score DESC, symbol) FROM (SELECT symbol, composite_score FROM scores ORDER BY composite_score DESC, symbol LIMIT 5)),
    (SELECT count_if(direction = 'bullish') FROM signals), (SELECT count_if(direction = 'bearish') FROM signals)) AS outlook FROM regime""",
    **parts("scores", "signals", "regime")))
register("K5_opportunities", lambda spark, d: rounded(rc.opportunities(scores_of(spark, d), signals_of(spark, d), 0.5, 0.3)), ctes(
    f"""SELECT kind, symbol, {rnd('value')} FROM (SELECT 1 AS kind, symbol, composite_score AS value FROM (SELECT * FROM scores ORDER BY composite_score DESC, symbol LIMIT 3)
    WHERE composite_score > 0.5 UNION ALL SELECT 2, symbol, CAST(count(*) AS DOUBLE) FROM signals WHERE direction = 'bullish' AND confidence > 0.3 GROUP BY symbol)
    ORDER BY kind, CASE WHEN kind = 1 THEN -value END, symbol LIMIT 5""", **parts("scores", "signals")))


def _risks(spark, d):
    return rc.risk_alerts(regime_of(spark, d), tiers_of(spark, d), signals_of(spark, d))


register("K6_risk_alerts", _risks, ctes(
    """SELECT 'regime risk: ' || regime AS risk FROM regime WHERE regime IN ('bear', 'volatile') UNION ALL SELECT 'high volatility' FROM regime WHERE volatility_signal > 0.8
    UNION ALL SELECT printf('many assets excluded (%d)', x) FROM (SELECT count_if(tier = 'excluded') AS x, count(*) AS n FROM tiers) WHERE x > n * 0.5
    UNION ALL SELECT printf('strong bearish signals (%d)', x) FROM (SELECT count_if(direction = 'bearish' AND confidence > 0.6) AS x FROM signals) WHERE x > 5""",
    **parts("regime", "tiers", "signals")))
register("K7_intelligence_stats", lambda spark, d: rounded(rc.intelligence_stats(
    scores_of(spark, d), tiers_of(spark, d), signals_of(spark, d), weights_of(spark, d))), ctes(
    f"""SELECT (SELECT count(*) FROM scores) AS assets_scored, {tidy('(SELECT avg(composite_score) FROM scores)')} AS avg_composite_score,
    {', '.join(f"(SELECT count_if(tier = '{t}') FROM tiers) AS {t}" for t in ('tier_1', 'tier_2', 'tier_3', 'reserve', 'excluded'))},
    (SELECT count(*) FROM signals) AS total_signals, (SELECT count(DISTINCT symbol) FROM signals) AS assets_with_signals,
    (SELECT count(*) FROM weights) AS portfolio_assets, {tidy('(SELECT sum(weight) FROM weights)')} AS total_allocation""", **parts(*WT, "signals")))
register("K7_top_positions", lambda spark, d: rounded(rc.top_positions(weights_of(spark, d))), ctes(
    f"SELECT symbol, {rnd('weight')} FROM (SELECT symbol, weight FROM weights ORDER BY weight DESC, symbol LIMIT 10)", **parts(*WT)))
