"""Queries P1-P10: pairs trading over the weekly nation panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.functions.tables import stored
from candlewick.functions.windows import over
from candlewick.operators import pairs as pt
from candlewick.operators import unitroot as ur
from candlewick.plans.dependence import nations
from candlewick.plans.registry import register
from candlewick.plans.sqltext import NATION, ctes, panel, rnd, tidy

P = {"bars": panel(NATION), "dts": "SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)",
     "sp": "SELECT b.*, CASE WHEN i <= floor(n * 0.7) THEN 'in' ELSE 'out' END AS sample FROM bars b JOIN dts USING (ts)",
     "ins": "SELECT * FROM sp WHERE sample = 'in'", "outs": "SELECT * FROM sp WHERE sample = 'out'"}


def sample(spark, d, part):
    return pt.split_sample(nations(spark, d)).filter(F.col("sample") == part).drop("sample")


register("P1_split_sample", lambda spark, d: pt.split_sample(nations(spark, d)).select("symbol", "ts", "close", "sample"),
         ctes("SELECT symbol, ts, close, sample FROM sp", **P))
register("P2_adf_test", lambda spark, d: rounded(ur.adf_table(sample(spark, d, "in"))))


def levels(spark, d):
    """The in-sample panel with each price's distance from its mean added up: the given prices are stationary, and sums of such are not."""
    bars = sample(spark, d, "in")
    s = over(bars)
    step = F.col("close") / F.avg("close").over(s.all) - 1
    summed = bars.withColumn("_step", step)
    return summed.withColumn("close", 100 + F.sum("_step").over(over(summed).running)).drop("_step")


register("P3_engle_granger_resid", lambda spark, d: rounded(pt.candidate_tests(levels(spark, d)).select("asset_i", "asset_j", "n", "beta", "resid_stat", "resid_p")))
register("P4_coint_test", lambda spark, d: rounded(pt.candidate_tests(levels(spark, d)).select("asset_i", "asset_j", "n", "coint_stat", "coint_p")))
register("P5_common_pairs", lambda spark, d: pt.common_pairs(stored(pt.candidate_tests(levels(spark, d)), "pair-tests")))
register("P6_rank_pairs", lambda spark, d: rounded(pt.rank_pairs(sample(spark, d, "in"))), ctes(
    f"SELECT a.symbol AS asset_i, b.symbol AS asset_j, {tidy('corr(a.close, b.close)')} AS corr FROM ins a JOIN ins b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL", **P))


def chain(src: str, tag: str) -> dict[str, str]:
    by = "PARTITION BY asset_i, asset_j ORDER BY ts"
    out = {
        f"ps{tag}": f"SELECT a.symbol AS asset_i, b.symbol AS asset_j, a.ts, a.close AS x, b.close AS y FROM {src} a JOIN {src} b ON a.ts = b.ts AND a.symbol < b.symbol",
        f"be{tag}": f"SELECT asset_i, asset_j, sum(x * y) / sum(x * x) AS beta FROM ps{tag} GROUP BY asset_i, asset_j",
        f"u{tag}": f"SELECT *, y - beta * x AS u FROM ps{tag} JOIN be{tag} USING (asset_i, asset_j)",
        f"z{tag}": f"SELECT *, (u - avg(u) OVER (PARTITION BY asset_i, asset_j)) / stddev_samp(u) OVER (PARTITION BY asset_i, asset_j) AS zscore FROM u{tag}",
        f"ev{tag}": f"""SELECT *, CASE WHEN pz > -1 AND zscore < -1 THEN -1 WHEN pz < 0 AND zscore > 0 THEN 0 END AS d,
            CASE WHEN pz < 1 AND zscore > 1 THEN 1 WHEN pz > 0 AND zscore < 0 THEN 0 END AS up FROM (SELECT *, lag(zscore) OVER ({by}) AS pz FROM z{tag})""",
        f"po{tag}": f"""SELECT asset_i, asset_j, ts, x, y, beta, zscore, coalesce(last_value(d IGNORE NULLS) OVER ({by}), 0) AS down,
            coalesce(last_value(up IGNORE NULLS) OVER ({by}), 0) AS up FROM ev{tag}"""}
    for name, side in (("down", -1), ("up", 1)):
        out[f"t{name}{tag}"] = f"""SELECT asset_i, asset_j, '{name}' AS direction, ets AS entry_ts, ts AS exit_ts, beta,
            {side} * CASE WHEN beta > 0 THEN 1 ELSE -1 END * (x - ex) AS x_profit, {-side} * (y - ey) AS y_profit FROM (
            SELECT *, lag(ts) OVER ({by}) AS ets, lag(x) OVER ({by}) AS ex, lag(y) OVER ({by}) AS ey FROM (
            SELECT *, {name} - lag({name}) OVER ({by}) AS tn FROM po{tag}) WHERE tn <> 0) WHERE sign(tn) = {-side} AND ets IS NOT NULL"""
    out[f"tr{tag}"] = f"SELECT * FROM tdown{tag} UNION ALL SELECT * FROM tup{tag}"
    out[f"pf{tag}"] = f"""SELECT coalesce(direction, 'all') AS direction, coalesce(asset_i || '/' || asset_j, 'all') AS pair, count(*) AS trades,
        sum(y_profit + beta * x_profit) AS profit FROM (SELECT * FROM tr{tag}) GROUP BY GROUPING SETS ((direction, asset_i, asset_j), (direction), ())"""
    return out


IN, OUT = chain("ins", "i"), chain("outs", "o")


def z_of(spark, d, part="in"):
    b = sample(spark, d, part)
    return pt.residual_zscore(b, pt.every_pair(b))


register("P7_residual_zscore", lambda spark, d: rounded(z_of(spark, d).select("asset_i", "asset_j", "ts", "beta", "zscore")), ctes(
    f"SELECT asset_i, asset_j, ts, {rnd('beta zscore')} FROM zi", **P, **IN))
register("P8_pair_positions", lambda spark, d: pt.positions(z_of(spark, d)).select("asset_i", "asset_j", "ts", "down", "up"), ctes(
    "SELECT asset_i, asset_j, ts, down, up FROM poi", **P, **IN))
register("P9_pair_trades", lambda spark, d: rounded(pt.pair_trades(pt.positions(z_of(spark, d)))), ctes(
    f"SELECT asset_i, asset_j, direction, entry_ts, exit_ts, {rnd('beta x_profit y_profit')} FROM tri", **P, **IN))


def _performance(spark, d):
    one = lambda part: pt.pair_performance(pt.pair_trades(pt.positions(z_of(spark, d, part)))).withColumn("sample", F.lit(part))
    return rounded(one("in").unionByName(one("out")), 3)


register("P10_pair_performance", _performance, ctes(
    f"SELECT 'in' AS sample, direction, pair, trades, {tidy('profit', 3)} AS profit FROM pfi UNION ALL SELECT 'out', direction, pair, trades, {tidy('profit', 3)} FROM pfo",
    **P, **IN, **OUT))
