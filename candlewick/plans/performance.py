"""Queries N1-N5: run records per market segment, built from the daily segment bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.functions.windows import over
from candlewick.operators import performance as pr
from candlewick.plans.registry import register
from candlewick.plans.sqltext import ASSETS, SEGMENT, SUPPLIER, W, ctes, lag, rnd, tidy
from candlewick.sources.market import assets, segment_bars, supplier_bars

AS_OF = "2000-06-15"


def records(spark, d):
    b = segment_bars(spark, d)
    s = over(b)
    day = F.dayofmonth("ts")
    n = F.col("volume").cast("long")
    return b.select(
        F.col("symbol").alias("portfolio"), "ts", F.col("close").alias("portfolio_value"), s.change("close").alias("daily_return"),
        (1 - F.col("close") / F.max("close").over(s.running)).alias("drawdown"), (F.col("volume") * 100).alias("amount_invested"),
        F.when(day == 1, "monthly_rebalance").when(day % 7 == 0, "full_pipeline").otherwise("daily_dca").alias("workflow_type"),
        n.alias("orders_submitted"), F.when(day % 5 == 0, n).otherwise(F.lit(0)).cast("long").alias("orders_failed"),
        (F.col("volume") + day).cast("double").alias("duration"), F.when(day % 5 == 0, "failed").otherwise("success").alias("workflow_status"))


N = {"bars": SEGMENT, "rec": f"""SELECT symbol AS portfolio, ts, close AS portfolio_value, close / nullif({lag('close')}, 0) - 1 AS daily_return,
    1 - close / max(close) OVER {W} AS drawdown, volume * 100 AS amount_invested,
    CASE WHEN day(ts) = 1 THEN 'monthly_rebalance' WHEN day(ts) % 7 = 0 THEN 'full_pipeline' ELSE 'daily_dca' END AS workflow_type,
    CAST(volume AS BIGINT) AS orders_submitted, CASE WHEN day(ts) % 5 = 0 THEN CAST(volume AS BIGINT) ELSE 0 END AS orders_failed,
    volume + day(ts) AS duration, CASE WHEN day(ts) % 5 = 0 THEN 'failed' ELSE 'success' END AS workflow_status FROM bars"""}
register("N1_performance_analytics", lambda spark, d: rounded(pr.analytics(records(spark, d))), ctes(
    f"""SELECT portfolio, min(ts) AS start, max(ts) AS "end", count(*) AS total_days, {tidy('sum(amount_invested)')} AS total_invested, {tidy('arg_max(portfolio_value, ts)')} AS final_value,
    {tidy('arg_max(portfolio_value, ts) / arg_min(portfolio_value, ts) - 1')} AS total_return, {tidy('avg(daily_return) * 252')} AS annual_return,
    {tidy('stddev_samp(daily_return) * sqrt(252)')} AS annual_volatility, {tidy('avg(daily_return) * 252 / nullif(stddev_samp(daily_return) * sqrt(252), 0)')} AS sharpe,
    {tidy('-max(drawdown)')} AS max_drawdown, count_if(workflow_type = 'daily_dca') AS dca_workflows, count_if(workflow_type = 'monthly_rebalance') AS rebalance_workflows,
    count_if(workflow_type = 'full_pipeline') AS pipeline_workflows FROM rec GROUP BY portfolio""", **N))
register("N2_health_status", lambda spark, d: pr.health_status(records(spark, d)).select(
    "portfolio", "ts", F.concat_ws(";", "alerts").alias("alerts"), "status"), ctes(
    """SELECT portfolio, ts, alerts, CASE WHEN k > 2 THEN 'error' WHEN k > 0 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT portfolio, ts,
    concat_ws(';', CASE WHEN f THEN 'execution failures' END, CASE WHEN l THEN 'daily loss' END, CASE WHEN x THEN 'drawdown' END) AS alerts,
    f::INT + l::INT + x::INT AS k FROM (SELECT portfolio, ts, orders_failed / greatest(orders_submitted, 1) > 0.1 AS f, coalesce(daily_return < -0.05, false) AS l,
    drawdown > 0.3 AS x FROM rec))""", **N))
register("N3_run_metrics", lambda spark, d: rounded(pr.run_metrics(records(spark, d), AS_OF)), ctes(
    f"""SELECT portfolio, count_if(t) AS runs_today, {tidy('avg(duration) FILTER (back <= 10)')} AS avg_duration,
    {tidy("avg((workflow_status = 'success')::INT) FILTER (back <= 50)")} AS success_rate, {tidy('coalesce(sum(amount_invested) FILTER (t), 0)')} AS invested_today,
    CAST(coalesce(sum(orders_submitted) FILTER (t), 0) AS BIGINT) AS orders_today FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY ts DESC) AS back,
    CAST(ts AS DATE) = DATE '{AS_OF}' AS t FROM rec) GROUP BY portfolio""", **N))
GATE = "2001-11-04 12:00:00"
register("N4_staleness_gate", lambda spark, d: rounded(pr.staleness_gate(supplier_bars(spark, d), GATE)), ctes(
    f"""SELECT symbols, newest, {rnd('age_hours')}, CASE WHEN symbols > 10 AND age_hours < 24 THEN 'reuse' ELSE 'update' END AS action FROM (
    SELECT symbols, newest, date_diff('second', newest, TIMESTAMP '{GATE}') / 3600.0 AS age_hours FROM (SELECT count(DISTINCT symbol) AS symbols, max(ts) AS newest FROM bars))""",
    bars=SUPPLIER))
register("N5_status_report", lambda spark, d: rounded(pr.status_report(records(spark, d), AS_OF)), ctes(
    f"""SELECT portfolio, ts AS last_run, workflow_status, {rnd('portfolio_value daily_return drawdown')}, workflows, workflows_today FROM (
    SELECT *, count(*) OVER (PARTITION BY portfolio) AS workflows, sum((CAST(ts AS DATE) = DATE '{AS_OF}')::BIGINT) OVER (PARTITION BY portfolio)::BIGINT AS workflows_today,
    row_number() OVER (PARTITION BY portfolio ORDER BY ts DESC) AS back FROM rec) WHERE back = 1""", **N))
register("N5_data_availability", lambda spark, d: pr.availability(supplier_bars(spark, d), assets(spark, d)), ctes(
    "SELECT sector, count(DISTINCT symbol) AS symbols FROM assets WHERE symbol IN (SELECT symbol FROM bars) GROUP BY sector", bars=SUPPLIER, assets=ASSETS))
