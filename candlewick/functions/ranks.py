"""Global ranks without a single-task sort.

Values are first collapsed to distinct ones with counts (ties and hot values are combined before the shuffle), then
spread over value buckets; only the few bucket totals are prefix-summed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def share_at_most(df: DataFrame, value: str, out: str, low: float = 0.0, high: float = 1.0, buckets: int = 256) -> DataFrame:
    """Add `out`: the exact share of rows whose `value` is at most the row's own (NULL for NULL).

    `low` and `high` only balance the buckets; values outside them are ranked correctly in the edge buckets.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    place = (F.col(value) - low) / (high - low) * buckets
    spread = counts.withColumn("_bucket", F.floor(F.greatest(F.least(place, F.lit(float(buckets))), F.lit(0.0))).cast("int"))
    totals = spread.groupBy("_bucket").agg(F.sum("_k").alias("_b"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most buckets + 1 rows
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = totals.select("_bucket", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_base"),
                         F.sum("_b").over(whole).alias("_n"))
    inside = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.join(base, "_bucket").select(
        value, ((F.col("_base") + F.sum("_k").over(inside)) / F.col("_n")).alias(out))
    return df.join(ranked, value, "left")
