"""Queries T1, T2, T4-T9, T11-T13: exploratory and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import reports as rp
from candlewick.operators import returns as rt
from candlewick.plans.common import rowwise
from candlewick.plans.recommendations import WT, parts, weights_of
from candlewick.plans.registry import register
from candlewick.plans.scoring import H, scores_of
from candlewick.plans.sqltext import GAPPY, SEGMENT, SUPPLIER, ctes, lag, rnd, roll, tidy
from candlewick.plans.tiers import I, tiers_of
from candlewick.sources.market import gappy_bars, segment_bars, supplier_bars

R = {"r": f"SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, 100 * (close / nullif({lag('close')}, 0) - 1) AS pct FROM bars"}
register("T1_null_counts", lambda spark, d: rp.null_counts(gappy_bars(spark, d)), ctes(
    """SELECT coalesce(symbol, 'all') AS symbol, count_if(close IS NULL) AS nulls, count(*) AS rows, count(DISTINCT symbol) AS assets FROM (SELECT symbol, close FROM bars)
    GROUP BY ROLLUP (symbol)""".replace("count(DISTINCT symbol)", "CASE WHEN grouping(symbol) = 1 THEN count(DISTINCT sym2) ELSE 1 END").replace(
        "(SELECT symbol, close FROM bars)", "(SELECT symbol, symbol AS sym2, close FROM bars)"), bars=GAPPY))
register("T2_describe_returns", lambda spark, d: rounded(rp.describe_returns(supplier_bars(spark, d)), 4), ctes(
    f"""SELECT symbol, count(pct) AS count, {tidy('avg(pct)', 4)} AS mean, {tidy('stddev_samp(pct)', 4)} AS std, {tidy('min(pct)', 4)} AS min, {tidy('quantile_cont(pct, 0.25)', 4)} AS q25,
    {tidy('median(pct)', 4)} AS median, {tidy('quantile_cont(pct, 0.75)', 4)} AS q75, {tidy('max(pct)', 4)} AS max FROM r GROUP BY symbol""", bars=SUPPLIER, **R))
rowwise("T4_rolling_vol_12", rt.rolling_vol_percent, ["vol_12_pct"],
        f"SELECT symbol, ts, 100 * {roll('stddev_samp', 'ret', 12)} * sqrt(12) AS vol_12_pct FROM r", **R)


def logs(spark, d, source=supplier_bars):
    return rt.log_returns(source(spark, d)).filter("log_return is not null")


LG = {"lg": f"SELECT symbol, ts, ln(close / nullif({lag('close')}, 0)) AS v FROM bars", "lr": "SELECT * FROM lg WHERE v IS NOT NULL"}
register("T5_histogram", lambda spark, d: rounded(rp.histogram(logs(spark, d), "log_return")), ctes(
    f"""SELECT symbol, CAST(bin AS INTEGER) AS bin, count(*) AS count, {tidy('any_value(lo + bin * w)')} AS left_edge FROM (SELECT symbol, v, lo, w, coalesce(least(floor((v - lo) / nullif(w, 0)), 19), 0) AS bin FROM lr
    JOIN (SELECT symbol, min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM lr GROUP BY symbol) USING (symbol)) GROUP BY symbol, bin""", bars=SUPPLIER, **LG))
register("T5_density", lambda spark, d: rounded(rp.density(logs(spark, d, segment_bars), "log_return")), ctes(
    f"""SELECT symbol, CAST(point AS INTEGER) AS point, {tidy('any_value(lo + point * (hi - lo) / 39)')} AS x, {tidy('sum(exp(-0.5 * ((lo + point * (hi - lo) / 39 - v) / h) ** 2)) / any_value(n * h * sqrt(2 * pi()))')} AS density
    FROM lr JOIN (SELECT symbol, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM lr GROUP BY symbol) USING (symbol), range(40) t(point) WHERE h > 0 GROUP BY symbol, point""",
    bars=SEGMENT, **LG))
register("T6_box_stats", lambda spark, d: rounded(rp.box_stats(logs(spark, d), "log_return")), ctes(
    f"""SELECT symbol, {rnd('q1 median q3')}, {tidy('min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))')} AS low_whisker,
    {tidy('max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))')} AS high_whisker, count_if(NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS outliers
    FROM lr JOIN (SELECT symbol, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM lr GROUP BY symbol) USING (symbol) GROUP BY symbol, q1, median, q3""",
    bars=SUPPLIER, **LG))
register("T7_risk_return_table", lambda spark, d: rounded(rp.risk_return_table(
    supplier_bars(spark, d), tiers_of(spark, d).select("symbol", F.col("allocation_weight").alias("weight"))), 4), ctes(
    f"""SELECT symbol, n, {rnd('annual_return annual_risk', 4)}, {tidy('coalesce(allocation_weight, 0)', 4)} AS weight, CASE WHEN coalesce(allocation_weight, 0) > 0.02 THEN symbol END AS label FROM (
    SELECT symbol, count(pct) AS n, avg(pct) * 252 AS annual_return, stddev_samp(pct) * sqrt(252) AS annual_risk FROM r GROUP BY symbol) LEFT JOIN (SELECT symbol, allocation_weight FROM tiers) USING (symbol) WHERE n > 10""",
    **I, **R))
register("T8_equal_weight_report", lambda spark, d: rounded(rp.equal_weight_report(segment_bars(spark, d)).drop("growth")), ctes(
    f"""SELECT ts, {tidy('m')} AS mean_return, {tidy('sum(ln(1 + m)) OVER (ORDER BY ts)')} AS log_growth, {tidy('CASE WHEN count(m) OVER f = 30 THEN stddev_samp(m) OVER f END * sqrt(252) * 100')} AS volatility_pct
    FROM (SELECT ts, avg(ret) AS m FROM r GROUP BY ts) WHERE m IS NOT NULL WINDOW f AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", bars=SEGMENT, **R))
register("T8_top_mean_return", lambda spark, d: rounded(rp.top_mean_return(supplier_bars(spark, d))), ctes(
    f"SELECT symbol, {rnd('mean_return')} FROM (SELECT symbol, avg(pct) AS mean_return FROM r GROUP BY symbol ORDER BY mean_return DESC, symbol LIMIT 10)", bars=SUPPLIER, **R))
register("T9_volatility_report", lambda spark, d: rounded(rp.volatility_report(supplier_bars(spark, d))), ctes(
    f"SELECT symbol, {tidy('v')} AS volatility, {tidy('(SELECT avg(v) FROM vv)')} AS mean_volatility FROM (SELECT * FROM vv ORDER BY v DESC NULLS LAST, symbol LIMIT 15)",
    bars=SUPPLIER, **R, vv="SELECT symbol, stddev_samp(pct) * sqrt(252) AS v FROM r GROUP BY symbol"))
register("T11_tier_counts", lambda spark, d: rp.tier_counts(tiers_of(spark, d)), ctes("SELECT tier, count(*) AS count FROM tiers GROUP BY tier", **I))
register("T11_score_top15", lambda spark, d: rounded(rp.top_rows(scores_of(spark, d), "composite_score", 15)), ctes(
    f"SELECT symbol, {rnd('composite_score')} FROM (SELECT * FROM scores ORDER BY composite_score DESC, symbol LIMIT 15)", **H))
register("T11_weights_top20", lambda spark, d: rounded(rp.top_rows(weights_of(spark, d), "weight", 20)), ctes(
    f"SELECT symbol, {rnd('weight')} FROM (SELECT * FROM weights ORDER BY weight DESC, symbol LIMIT 20)", **parts(*WT)))
rowwise("T12_signed_return_split", rt.signed_split, ["gain", "loss"],
        "SELECT symbol, ts, CASE WHEN ret > 0 THEN ret WHEN ret IS NOT NULL THEN 0 END AS gain, CASE WHEN ret < 0 THEN ret WHEN ret IS NOT NULL THEN 0 END AS loss FROM r", **R)
rowwise("T13_rolling_price_stats", rt.rolling_price_stats, ["price_mean", "return_std"],
        f"SELECT symbol, ts, {roll('avg', 'close', 6)} AS price_mean, {roll('stddev_samp', 'ret', 5)} AS return_std FROM r", **R)
