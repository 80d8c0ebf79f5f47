"""Queries L1-L16: portfolios over the weekly nation panel, and tier-bound steps over the supplier tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import cleaning as cl
from candlewick.operators import dependence as dp
from candlewick.operators import portfolio as pf
from candlewick.operators import shrinkage as sk
from candlewick.plans.dependence import NAT, nations
from candlewick.plans.recommendations import WT, parts, weights_of
from candlewick.plans.registry import register
from candlewick.plans.riskmodels import universes
from candlewick.plans.sqltext import SUPPLIER, ctes, lag, panel, rnd, tidy
from candlewick.plans.tiers import I, tiers_of
from candlewick.sources.market import supplier_bars

register("L1_expected_returns", lambda spark, d: rounded(pf.expected_returns(weights_of(spark, d), 3)), ctes(
    f"SELECT symbol, tier, {tidy('(composite_score - 0.5) * 0.4')} AS mu FROM weights WHERE (SELECT count(*) FROM weights) >= 3", **parts(*WT)))


def _recent(spark, d):
    """Covariance of the recommended assets, 18 at most: only their bars are made."""
    listed = weights_of(spark, d).select("symbol").persist()
    return pf.recent_covariance(cl.panel(supplier_bars(spark, d).join(F.broadcast(listed), "symbol", "left_semi")), listed)


register("L1_covariance", lambda spark, d: rounded(_recent(spark, d)), ctes(
    f"""SELECT a.symbol AS asset_i, b.symbol AS asset_j, {tidy('covar_samp(a.ret, b.ret) * 252')} AS cov FROM al a JOIN al b ON a.ts = b.ts AND a.symbol <= b.symbol
    GROUP BY a.symbol, b.symbol HAVING count(*) >= 60""", **parts(*WT), pbars=panel(SUPPLIER),
    pr=f"""SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM pbars
        WHERE symbol IN (SELECT symbol FROM weights)""",
    tl="SELECT symbol, ts, ret FROM pr WHERE back <= 252 AND ret IS NOT NULL",
    al="SELECT * FROM tl WHERE ts IN (SELECT ts FROM tl GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM tl))"))


def base(spark, d):
    """Returns, expected returns, covariance and volume-based weights of the nation universe."""
    bars = nations(spark, d)
    r = dp.returns_matrix(bars)
    v = bars.groupBy("symbol").agg(F.sum("volume").alias("v"))
    w = v.select("symbol", (F.col("v") / v.agg(F.sum("v")).scalar()).alias("weight"))
    return r, pf.mean_returns(r), dp.cov_matrix(r), w


L = {**NAT, "mu": "SELECT symbol, avg(ret) * 252 AS mu FROM r GROUP BY symbol",
     "cov": "SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) * 252 AS c FROM r a JOIN r b ON a.ts = b.ts GROUP BY a.symbol, b.symbol",
     "w": "SELECT symbol, sum(volume) / (SELECT sum(volume) FROM bars) AS weight FROM bars GROUP BY symbol",
     "pv": "SELECT sqrt(sum(a.weight * b.weight * c)) AS vol FROM cov JOIN w a ON a.symbol = i JOIN w b ON b.symbol = j",
     "pm": "SELECT sum(weight * mu) AS ret FROM w JOIN mu USING (symbol)"}


def _stats(spark, d):
    _, mu, cov, w = base(spark, d)
    return pf.portfolio_stats(w, mu, cov)


register("L2_portfolio_stats", lambda spark, d: rounded(_stats(spark, d)), ctes(
    f"SELECT {tidy('ret')} AS ret, {tidy('vol')} AS volatility, {tidy('(ret - 0.10) / vol')} AS sharpe FROM pm, pv", **L))


def _solved(spark, d):
    """One universe a region and one of all nations, each solved by a task of its own."""
    _, mu, cov, _ = base(spark, d)
    listed = universes(spark, d)
    keyed = cov.join(listed.withColumnRenamed("symbol", "asset_i"), "asset_i").join(listed.withColumnRenamed("symbol", "asset_j"), ["universe", "asset_j"])
    return pf.closed_form(mu, keyed, universe="universe")


register("L3_min_variance_weights", lambda spark, d: rounded(_solved(spark, d).select("universe", "symbol", "min_variance")))
register("L4_max_sharpe_weights", lambda spark, d: rounded(_solved(spark, d).select("universe", "symbol", "max_sharpe")))
register("L5_efficient_frontier", lambda spark, d: rounded(pf.efficient_frontier(_solved(spark, d), 0.0, 100.0)))


def _line(spark, d):
    _, mu, cov, w = base(spark, d)
    return pf.capital_market_line(mu, pf.portfolio_stats(w, mu, cov))


register("L6_capital_market_line", lambda spark, d: rounded(_line(spark, d)), ctes(
    f"SELECT symbol, {rnd('mu')}, {tidy('vol * (mu - 0.2) / nullif(ret - 0.2, 0)')} AS line_risk FROM mu, pm, pv", **L))

N = 10_000
RAND = {**L, "idx": "SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM mu",
        "raw": f"SELECT id, symbol, CAST(((id + 1) * 7919 + k * 104729 + (id + 1) * k * 31) % 9973 AS DOUBLE) + 1 AS raw FROM range({N}) t(id), idx",
        "rw": "SELECT id, symbol, raw / sum(raw) OVER (PARTITION BY id) AS weight FROM raw",
        "rs": """SELECT id, ret, sqrt(v) AS vol FROM (SELECT id, sum(weight * mu) AS ret FROM rw JOIN mu USING (symbol) GROUP BY id) JOIN
            (SELECT a.id, sum(a.weight * b.weight * c) AS v FROM cov JOIN rw a ON a.symbol = i JOIN rw b ON b.symbol = j AND a.id = b.id GROUP BY a.id) USING (id)"""}


def _random(spark, d):
    _, mu, cov, _ = base(spark, d)
    return pf.random_portfolios(spark, mu, cov, N)


register("L7_random_portfolios", lambda spark, d: rounded(_random(spark, d)), ctes(
    f"SELECT id, {rnd('ret')}, {tidy('vol')} AS volatility, {tidy('ret / vol')} AS sharpe FROM rs", **RAND))
register("L7_best_random", lambda spark, d: rounded(pf.best_of(_random(spark, d))), ctes(
    f"""SELECT 'min_risk' AS kind, id, {rnd('ret')}, {tidy('vol')} AS volatility, {tidy('ret / vol')} AS sharpe FROM (SELECT * FROM rs ORDER BY vol, id LIMIT 1)
    UNION ALL SELECT 'max_sharpe', id, {tidy('ret')}, {tidy('vol')}, {tidy('ret / vol')} FROM (SELECT * FROM rs ORDER BY ret / vol DESC, id LIMIT 1)""", **RAND))


def _bounded(spark, d, target=None):
    _, mu, cov, _ = base(spark, d)
    return pf.bounded_best(spark, mu, cov, 0.0001, 0.09, N, target=target)


INSIDE = "id IN (SELECT id FROM rw GROUP BY id HAVING min(weight) >= 0.0001 AND max(weight) <= 0.09)"
register("L8_bounded_best_portfolio", lambda spark, d: rounded(_bounded(spark, d)), ctes(
    f"SELECT id, symbol, {rnd('weight')} FROM rw WHERE id = (SELECT id FROM rs WHERE {INSIDE} ORDER BY (ret - 0.10) / vol DESC, id LIMIT 1)", **RAND))
register("L8_bounded_target_return", lambda spark, d: rounded(_bounded(spark, d, 0.5)), ctes(
    f"SELECT id, symbol, {rnd('weight')} FROM rw WHERE id = (SELECT id FROM rs WHERE {INSIDE} AND ret >= 0.5 ORDER BY vol, id LIMIT 1)", **RAND))


def tiered(spark, d):
    t = tiers_of(spark, d).filter(F.col("tier").isin("tier_1", "tier_2", "tier_3"))
    return t.select("symbol", "tier", "volatility", "allocation_weight")


def _inverse(spark, d):
    t = tiered(spark, d)
    return pf.inverse_vol_weights(t).join(t.select("symbol", "tier"), "symbol")


TI = {**I, "tt": "SELECT symbol, tier, volatility, allocation_weight FROM tiers WHERE tier IN ('tier_1', 'tier_2', 'tier_3')",
      "iv": "SELECT symbol, tier, allocation_weight, 1 / volatility / sum(1 / volatility) OVER () AS weight FROM tt"}
register("L9_inverse_vol_weights", lambda spark, d: rounded(_inverse(spark, d)), ctes(f"SELECT symbol, tier, {rnd('weight')} FROM iv", **TI))
register("L9_equal_weights", lambda spark, d: rounded(pf.equal_weights(tiered(spark, d))), ctes(
    f"SELECT symbol, {tidy('1.0 / count(*) OVER ()')} AS weight FROM tt", **TI))
BO = {**TI, "cut": "SELECT symbol, tier, allocation_weight, greatest(least(weight, 0.05), 0.005) AS w FROM iv",
      "sm": """SELECT *, sum(w) OVER (PARTITION BY tier) AS s, CASE tier WHEN 'tier_1' THEN 0.45 WHEN 'tier_2' THEN 0.25 ELSE 0.1 END AS lo,
          CASE tier WHEN 'tier_1' THEN 0.55 WHEN 'tier_2' THEN 0.35 ELSE 0.2 END AS hi FROM cut""",
      "sl": "SELECT *, w * CASE WHEN s > hi THEN hi / s WHEN s < lo AND s > 0 THEN lo / s ELSE 1 END AS x FROM sm",
      "bw": "SELECT symbol, tier, allocation_weight, x * 0.95 / sum(x) OVER () AS weight FROM sl"}


def bounded_of(spark, d):
    return pf.apply_bounds(_inverse(spark, d))


register("L10_apply_weight_bounds", lambda spark, d: rounded(bounded_of(spark, d).select("symbol", "tier", "weight")), ctes(
    f"SELECT symbol, tier, {rnd('weight')} FROM bw", **BO))


def _rebalance(spark, d):
    now = tiered(spark, d).select("symbol", F.col("allocation_weight").alias("weight"))
    return pf.rebalance_actions(bounded_of(spark, d), now)


register("L11_rebalance_actions", lambda spark, d: rounded(_rebalance(spark, d)), ctes(
    f"""SELECT symbol, {tidy('weight')} AS target_weight, {tidy('allocation_weight')} AS current_weight, {tidy('weight - allocation_weight')} AS change,
    CASE WHEN weight > allocation_weight THEN 'BUY' ELSE 'SELL' END AS action FROM bw
    WHERE abs(weight - allocation_weight) > 0.25 * allocation_weight AND abs(weight - allocation_weight) > 0.001""", **BO))
register("L12_tier_allocation", lambda spark, d: rounded(pf.tier_allocation(bounded_of(spark, d))), ctes(
    f"SELECT tier, {tidy('sum(weight)')} AS weight FROM bw GROUP BY tier UNION ALL SELECT 'reserve', 0.05", **BO))
register("L13_parametric_var", lambda spark, d: rounded(pf.parametric_risk(_stats(spark, d)).select("var_95", "return_var_95", "drawdown_estimate")), ctes(
    f"SELECT {tidy('1.6448536269514722 * vol')} AS var_95, {tidy('ret - 1.645 * vol')} AS return_var_95, {tidy('2.5 * vol')} AS drawdown_estimate FROM pm, pv", **L))


def _div(spark, d):
    _, _, cov, w = base(spark, d)
    return pf.diversification(w, cov)


register("L14_portfolio_diversification", lambda spark, d: rounded(_div(spark, d)), ctes(
    f"SELECT {tidy('(SELECT sum(weight * sqrt(c)) FROM w JOIN cov ON i = symbol AND j = symbol) / (SELECT vol FROM pv)')} AS diversification_ratio", **L))


def _risk(spark, d):
    _, _, cov, w = base(spark, d)
    return pf.risk_contribution(w, cov)


register("L15_risk_contribution", lambda spark, d: rounded(_risk(spark, d)), ctes(
    f"SELECT symbol, {rnd('weight')}, {tidy('x / sum(x) OVER ()')} AS risk_share FROM (SELECT a.symbol, a.weight, a.weight * sum(b.weight * c) AS x FROM cov "
    "JOIN w a ON a.symbol = i JOIN w b ON b.symbol = j GROUP BY a.symbol, a.weight)", **L))


def _series(spark, d):
    r, _, _, w = base(spark, d)
    return pf.portfolio_series(r, w)


register("L16_portfolio_series", lambda spark, d: rounded(_series(spark, d)), ctes(
    f"SELECT ts, {tidy('p')} AS portfolio_return, {tidy('sum(p) OVER (ORDER BY ts)')} AS cumulative FROM (SELECT ts, sum(ret * weight) AS p FROM r JOIN w USING (symbol) GROUP BY ts)", **L))

SHRUNK = {**NAT, "dev": "SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM r",
          "sq": "SELECT a.symbol AS i, b.symbol AS j, count(*) AS n, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q FROM dev a JOIN dev b ON a.ts = b.ts GROUP BY a.symbol, b.symbol",
          "su": "SELECT max(n) AS n, count(CASE WHEN i = j THEN 1 END) AS assets, avg(CASE WHEN i = j THEN s END) AS target, sum(s * s) AS ss, sum(q) AS qq FROM sq",
          "sh": "SELECT n, assets, target, greatest(least((qq - ss) / n, ss - assets * target * target), 0) / (ss - assets * target * target) AS intensity FROM su"}
register("U3_shrinkage_intensity", lambda spark, d: rounded(sk.shrinkage_intensity(dp.returns_matrix(nations(spark, d)))), ctes(
    f"SELECT n, assets, {rnd('target intensity')} FROM sh", **SHRUNK))
register("U3_shrunk_covariance", lambda spark, d: rounded(sk.shrunk_covariance(dp.returns_matrix(nations(spark, d)))), ctes(
    f"SELECT i AS asset_i, j AS asset_j, {tidy('((1 - intensity) * s + CASE WHEN i = j THEN intensity * target ELSE 0 END) * 252')} AS cov FROM sq, sh WHERE i <= j", **SHRUNK))
