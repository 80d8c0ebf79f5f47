"""Market views over the given tables.

Each view is keyed by (symbol, ts) on a fixed grain and built with partial aggregation, so a hot symbol is combined
before the shuffle and one symbol's series is never longer than the calendar: days for `supplier_bars`, `segment_bars`
and `nation_bars`, hours for `event_bars`. Finer grains have no such bound; see `functions.segments`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.guards import div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(ticks: DataFrame, order: list[str], volume: Column, quote: Column, source: str) -> DataFrame:
    """Fold ticks (symbol, ts, price, ...) to one bar per (symbol, ts); open and close follow `order`."""
    key = F.struct(*order)
    return ticks.groupBy("symbol", "ts").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), volume.cast("double").alias("volume"),
        F.round(quote, 2).alias("quote_volume"),
    ).withColumn("source", F.lit(source))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: price is extended price per unit."""
    ticks = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"),
        div("l_extendedprice", "l_quantity").alias("price"),
        "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return to_bars(ticks, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                   F.sum("l_quantity"), F.sum("l_extendedprice"), "lineitem")


def _order_ticks(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col(symbol).cast("string").alias("symbol"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "symbol", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), "o_orderkey")


def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily bars per market segment: the small aligned panel."""
    return to_bars(_order_ticks(spark, sf_dir, "c_mktsegment"), ["o_orderkey"],
                   F.count(F.lit(1)), F.sum("price"), "orders")


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per customer nation: the wider aligned panel."""
    return to_bars(_order_ticks(spark, sf_dir, "c_nationkey"), ["o_orderkey"],
                   F.count(F.lit(1)), F.sum("price"), "orders")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type, from events with a positive value."""
    ticks = table(spark, sf_dir, "events").filter(F.col("value") > 0).select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
        F.col("ts").alias("at"), F.col("value").alias("price"), "event_id")
    return to_bars(ticks, ["at", "event_id"], F.count(F.lit(1)), F.sum("price"), "events")


def live_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as a trade tape."""
    return table(spark, sf_dir, "events").filter(F.col("value") > 0).select(
        F.col("event_id").alias("trade_id"), "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), "user_id",
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset dimension: one row per supplier; the absolute balance scaled stands in for market cap."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    cap = F.round(F.abs("s_acctbal") * 20000, 2)
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"),
        cap.alias("market_cap_usd"), F.round(cap * 5, 2).alias("market_cap_brl"),
        F.when(F.col("s_suppkey") % 3 != 0, F.round(F.abs("s_acctbal") * 30, 2)).alias("daily_volume_brl"),
        F.when(F.col("s_suppkey") % 4 != 0, F.date_add(
            F.lit("2008-06-01").cast("date"), (F.col("s_suppkey") % 200 * 37).cast("int")).cast("timestamp_ntz")).alias("listing_date"),
        (F.col("s_acctbal") > 0).alias("is_active"), F.col("n_name").alias("exchange"),
        F.col("r_name").alias("sector"), F.lit("supplier").alias("source"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("last_updated"))


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier bars with fixed defects placed by date arithmetic, for the quality checks and the cleaners."""
    k = (F.datediff("ts", F.lit("1970-01-01")) + F.col("symbol").cast("long") * 7).cast("long")
    bars = supplier_bars(spark, sf_dir).withColumn("k", k)
    hit = lambda m, r: F.col("k") % m == r
    odd = F.col("symbol").cast("long") % 3
    base = bars.select(
        "symbol", "ts", "open", F.when(hit(53, 1) & (odd == 1), F.col("low") * 0.5).otherwise(F.col("high")).alias("high"),
        "low", F.when(hit(29, 3), F.lit(None)).when(hit(61, 5), F.col("close") * 10).otherwise(F.col("close")).alias("close"),
        F.when(hit(71, 2) & (odd == 2), -F.col("volume")).when(hit(37, 4), F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
        "quote_volume", "k")
    twice = base.filter(hit(97, 0) & (odd == 0))
    return base.unionByName(twice).drop("k")


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier bars on the full daily calendar of each symbol; days without a bar are NULL."""
    bars = supplier_bars(spark, sf_dir)
    days = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "symbol", F.explode(F.expr("sequence(to_date(a), to_date(b), interval 1 day)")).alias("d")).select(
        "symbol", F.col("d").cast("timestamp_ntz").alias("ts")).repartition("symbol", "ts")  # sized after the calendar is unfolded
    return days.join(bars, ["symbol", "ts"], "left")
