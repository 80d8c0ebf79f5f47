"""Price parity between two sources of the same symbols: deviations within a tolerance of time, and gaps on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.asof import ROWS, asof_join
from candlewick.functions.guards import div, flag


def price_parity(one: DataFrame, other: DataFrame, tolerance: float = 3600.0, limit: float = 0.02, price: str = "close", rows: int = ROWS) -> DataFrame:
    """(symbol, ts, side, price, other_ts, other_price, age, deviation, breach, gap) for every bar of both sources.

    side 'one' has the bars of the first source beside the newest bar of the second within `tolerance` seconds, side 'other' the other way
    round. deviation is own / other - 1, breach 1 where it is larger than `limit` either way, gap 1 where nothing is near enough. age in seconds.
    Bars without a price are left out.
    """
    def side(name: str, own: DataFrame, against: DataFrame) -> DataFrame:
        mine, theirs = (x.select("symbol", "ts", F.col(price).alias("price")).filter(F.col("price").isNotNull()) for x in (own, against))
        met = asof_join(mine, theirs, tolerance, ["price"], rows=rows)
        age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("other_ts").cast("timestamp"))) / 1e6
        deviation = div("price", "other_price") - 1
        return met.select("symbol", "ts", F.lit(name).alias("side"), "price", "other_ts", "other_price", age.alias("age"), deviation.alias("deviation"),
                          flag(F.abs(deviation) > limit).alias("breach"), flag(F.col("other_ts").isNull()).alias("gap"))

    return side("one", one, other).unionByName(side("other", other, one))


def parity_summary(parity: DataFrame) -> DataFrame:
    """Per symbol and side: bars, gaps, breaches, mean and largest absolute deviation, mean age, newest bar."""
    size = F.abs("deviation")
    return parity.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("gap").alias("gaps"), F.sum("breach").alias("breaches"), F.avg(size).alias("mean_deviation"),
        F.max(size).alias("max_deviation"), F.avg("age").alias("mean_age"), F.max("ts").alias("newest"))
