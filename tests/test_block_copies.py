"""How often a block of packed series travels."""

from pyspark.sql import functions as F

from candlewick.functions.blocks import value_blocks


def test_short_series_travel_to_eight_blocks(spark):
    """6000 short series fill no block, so blocks only keep the cores busy: each of them is one more copy of the table in the shuffle."""
    table = spark.range(6000).select(F.col("id").cast("string").alias("symbol"), F.encode(F.repeat(F.lit("x"), 80), "utf-8").alias("v"))
    assert value_blocks(table) <= 8
    assert value_blocks(table.limit(100)) == 1
