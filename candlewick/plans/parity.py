"""U1: parity of two sources of supplier bars, those of odd and of even order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import div, rounded
from candlewick.operators import parity as pa
from candlewick.plans.registry import register
from candlewick.plans.sqltext import _bars, ctes, rnd, tidy
from candlewick.sources.market import table, to_bars

TOLERANCE, LIMIT = 3 * 86_400.0, 0.25


def _source(spark, d, odd: int):
    ticks = table(spark, d, "lineitem").filter(F.col("l_linenumber") % 2 == odd).select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"), div("l_extendedprice", "l_quantity").alias("price"),
        "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return to_bars(ticks, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], F.sum("l_quantity"), F.sum("l_extendedprice"), f"lines-{odd}")


def _parity(spark, d):
    return pa.price_parity(_source(spark, d, 1), _source(spark, d, 0), TOLERANCE, LIMIT)


def _sql_source(odd: int) -> str:
    return _bars(f"SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, * FROM lineitem WHERE l_linenumber % 2 = {odd}",
                 "l_orderkey, l_linenumber, l_partkey, l_extendedprice", "sum(l_quantity)", "sum(l_extendedprice)")


def _side(name: str, own: str, other: str) -> str:
    near = f"date_diff('second', b.ts, a.ts) <= {int(TOLERANCE)}"
    return f"""SELECT symbol, ts, '{name}' AS side, price, other_ts, other_price, CAST(date_diff('second', other_ts, ts) AS DOUBLE) AS age, price / nullif(other_price, 0) - 1 AS deviation FROM (
      SELECT a.symbol, a.ts, a.close AS price, CASE WHEN {near} THEN b.ts END AS other_ts, CASE WHEN {near} THEN b.close END AS other_price
      FROM {own} a ASOF LEFT JOIN {other} b ON a.symbol = b.symbol AND a.ts >= b.ts)"""


SQL = {"s1": _sql_source(1), "s0": _sql_source(0), "sides": f"{_side('one', 's1', 's0')} UNION ALL {_side('other', 's0', 's1')}",
       "parity": f"SELECT *, CASE WHEN abs(deviation) > {LIMIT} THEN 1 ELSE 0 END AS breach, CASE WHEN other_ts IS NULL THEN 1 ELSE 0 END AS gap FROM sides"}
register("U1_price_parity", lambda spark, d: rounded(_parity(spark, d)), ctes(
    f"SELECT symbol, ts, side, {rnd('price')}, other_ts, {rnd('other_price age deviation')}, breach, gap FROM parity", **SQL))
register("U1_parity_summary", lambda spark, d: rounded(pa.parity_summary(_parity(spark, d))), ctes(
    f"""SELECT symbol, side, count(*) AS bars, sum(gap) AS gaps, sum(breach) AS breaches, {tidy('avg(abs(deviation))')} AS mean_deviation,
    {tidy('max(abs(deviation))')} AS max_deviation, {tidy('avg(age)')} AS mean_age, max(ts) AS newest FROM parity GROUP BY symbol, side""", **SQL))
