"""Queries M1-M6: trade lists towards the tier allocation, and accounting over orders and the trade tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import execution as ex
from candlewick.plans.allocation import TI, tiered
from candlewick.plans.registry import register
from candlewick.plans.sqltext import TRADES, ctes, rnd, tidy
from candlewick.sources.market import live_trades, table

CAPITAL = 250_000.0


def _weights(spark, d):
    t = tiered(spark, d)
    return t.select("symbol", F.col("allocation_weight").alias("weight")), t.select(
        "symbol", F.when(F.col("symbol").cast("long") % 2 == 0, 0.02).otherwise(0.004).alias("weight"))


def trades_of(spark, d):
    return ex.required_trades(*_weights(spark, d), CAPITAL)


M = {**TI, "trd": f"""SELECT symbol, t AS target_weight, c AS current_weight, CASE WHEN t > c THEN 'buy' ELSE 'sell' END AS side, abs(t - c) * {CAPITAL} AS amount FROM (
    SELECT symbol, allocation_weight AS t, CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN 0.02 ELSE 0.004 END AS c FROM tt)
    WHERE abs(t - c) >= 0.001 AND abs(t - c) * {CAPITAL} >= 25"""}
register("M1_required_trades", lambda spark, d: rounded(trades_of(spark, d)), ctes(
    f"SELECT symbol, side, {rnd('target_weight current_weight amount')} FROM trd", **M))


def sessions(spark, d):
    """Every market order as a trade request, one session per day."""
    o = table(spark, d, "orders")
    return o.select(F.to_date("o_orderdate").alias("session"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("symbol"),
                    F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
                    F.round(F.col("o_totalprice") / 40, 2).alias("amount"), (F.col("o_orderkey") % 100 / 1000.0).alias("target_weight"))


B = "OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CHK = {"ses": """SELECT CAST(o_orderdate AS DATE) AS session, o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS symbol,
        CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, round(o_totalprice / 40, 2) AS amount, o_orderkey % 100 / 1000.0 AS target_weight FROM orders""",
       "rn": f"SELECT *, count(*) {B} AS n, coalesce(sum(amount) {B}, 0) AS v FROM ses",
       "chk": """SELECT *, concat_ws(';', CASE WHEN amount > 10000 THEN 'order above maximum' END, CASE WHEN amount < 25 THEN 'order below minimum' END,
        CASE WHEN n >= 5 THEN 'daily trade limit' END, CASE WHEN side = 'buy' AND target_weight > 0.05 THEN 'position limit' END,
        CASE WHEN v + amount > 30000 THEN 'daily volume limit' END) AS violations FROM rn"""}
LIM = {"daily_trades": 5, "daily_volume": 30_000.0}
register("M2_risk_check", lambda spark, d: ex.risk_check(sessions(spark, d), **LIM).select(
    "session", "seq", "side", F.concat_ws(";", "violations").alias("violations"), "passed"), ctes(
    "SELECT session, seq, side, violations, violations = '' AS passed FROM chk", **CHK))
register("M3_dca_allocation", lambda spark, d: rounded(ex.dca_allocation(_weights(spark, d)[0], CAPITAL / 10, "2024-01-02 10:00:00")), ctes(
    f"""SELECT symbol, CAST(i AS INTEGER) AS slice, {tidy('total / n')} AS amount, TIMESTAMP '2024-01-02 10:00:00' + to_minutes(CAST((i - 1) * 30 AS BIGINT)) AS ts FROM (
    SELECT symbol, total, n, unnest(generate_series(1, n)) AS i FROM (SELECT symbol, allocation_weight * {CAPITAL / 10} AS total,
    CASE WHEN allocation_weight * {CAPITAL / 10} > 1000 THEN 4 ELSE 1 END AS n FROM tt) WHERE total >= 25)""", **TI))


def fills_of(spark, d):
    return live_trades(spark, d).select("symbol", "ts", "trade_id", "side", "price", (F.col("price") * F.col("size")).alias("value"))


S = "OVER (PARTITION BY symbol ORDER BY ts, trade_id)"
register("M4_position_rollup", lambda spark, d: rounded(ex.position_rollup(fills_of(spark, d)), 4), ctes(
    f"""SELECT symbol, count(*) AS fills, {tidy('arg_max(q, (ts, trade_id)) - least(min(q), 0)', 4)} AS quantity, {tidy('arg_max(v, (ts, trade_id)) - least(min(v), 0)', 4)} AS value,
    {tidy('CASE WHEN arg_max(q, (ts, trade_id)) - least(min(q), 0) > 1e-9 THEN (arg_max(v, (ts, trade_id)) - least(min(v), 0)) / (arg_max(q, (ts, trade_id)) - least(min(q), 0)) ELSE 0 END', 4)} AS avg_price
    FROM (SELECT symbol, ts, trade_id, sum(sg * size) {S} AS q, sum(sg * price * size) {S} AS v FROM (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg FROM trades)) GROUP BY symbol""",
    trades=TRADES))


def executed(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.date_trunc("month", "o_orderdate").cast("date").alias("session"),
                    F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "P", "failed").otherwise("cancelled").alias("status"),
                    F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 100 / 10000.0).alias("slippage"),
                    (F.col("o_totalprice") > 400000).cast("int").alias("violations"))


register("M5_execution_summary", lambda spark, d: rounded(ex.execution_summary(executed(spark, d)), 3), ctes(
    f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS session, count(*) AS submitted, count_if(o_orderstatus = 'F') AS filled, count_if(o_orderstatus <> 'F') AS failed,
    {tidy("100.0 * count_if(o_orderstatus = 'F') / count(*)", 3)} AS success_rate, {tidy("coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0)", 3)} AS value,
    {tidy("coalesce(avg(o_orderkey % 100 / 10000.0) FILTER (o_orderstatus = 'F'), 0)", 3)} AS average_slippage,
    {tidy("coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) * 0.005", 3)} AS costs, CAST(sum((o_totalprice > 400000)::INT) AS BIGINT) AS violations
    FROM orders GROUP BY 1"""))
register("M6_execution_plan", lambda spark, d: ex.execution_plan(sessions(spark, d), **LIM).select(
    "session", "seq", "side", "checks_passed", "checks_failed"), ctes(
    """SELECT session, seq, side, checks_passed, checks_failed FROM chk JOIN (SELECT session, count_if(violations = '') AS checks_passed, count_if(violations <> '') AS checks_failed
    FROM chk GROUP BY session) USING (session) WHERE violations = ''""", **CHK))
