"""Long series: one symbol may hold a large share of all bars, so its window work is split by row position.

A series no longer than `rows` stays whole. A longer one is cut into runs of `rows` bars; each run also receives the
last `halo` bars of the run before it as warm-up, which is all that a rolling operator looking back at most `halo`
rows can see. Positions are exact: bars are counted per (symbol, time block) with map-side combine, the small counts are
prefix-summed, and only the bars inside one block are ranked together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.windows import SEGMENT

WARM = "_warm"
ROWS = 1_000_000


def with_position(bars: DataFrame, rows: int = ROWS) -> DataFrame:
    """Add `_pos`, the zero-based row position of each bar in its series, without sorting a long series in one task."""
    span = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    # at most total/rows series qualify, and AQE broadcasts them only below its size threshold
    long = span.filter(F.col("_n") > rows).select(
        "symbol", "_t0",
        (F.timestamp_diff("SECOND", F.col("_t0"), F.col("_t1")) / F.ceil(F.col("_n") / rows) + 1).alias("_width"))
    block = F.coalesce(
        F.floor(F.timestamp_diff("SECOND", F.col("_t0"), F.col("ts")) / F.col("_width")), F.lit(0)).cast("long")
    placed = bars.join(long, "symbol", "left").withColumn("_block", block).drop("_t0", "_width")
    counts = placed.groupBy("symbol", "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset")).filter(
        F.col("_block") > 0)
    inside = Window.partitionBy("symbol", "_block").orderBy("ts")
    return (placed.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(offsets, ["symbol", "_block"], "left")
            .withColumn("_pos", F.col("_rank") + F.coalesce("_offset", F.lit(0)))
            .drop("_rank", "_offset", "_block"))


def split(bars: DataFrame, halo: int, rows: int = ROWS) -> DataFrame:
    """Add the segment key, repeating the last `halo` bars of each segment as warm-up rows of the next."""
    if halo >= rows:
        raise ValueError("halo must be smaller than rows")
    placed = with_position(bars, rows)
    own = F.floor(F.col("_pos") / rows)
    spill = (F.col("_pos") % rows) >= rows - halo
    return (placed
            .withColumn("_own", own)
            .withColumn(SEGMENT, F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))))
            .withColumn(WARM, F.col(SEGMENT) != F.col("_own"))
            .drop("_own", "_pos"))


def in_segments(bars: DataFrame, operator: Callable[[DataFrame], DataFrame], halo: int, rows: int = ROWS) -> DataFrame:
    """Run a row-preserving rolling operator over split series; equal to running it over whole ones."""
    done = operator(split(bars, halo, rows))
    return done.filter(~F.col(WARM)).drop(WARM, SEGMENT)


def running_totals(bars: DataFrame, columns: dict[str, str], rows: int = ROWS) -> DataFrame:
    """Cumulative sums {output: input} of long series: sums inside each segment plus the carry of all earlier ones."""
    own = with_position(bars, rows).withColumn(SEGMENT, F.floor(F.col("_pos") / rows)).drop("_pos")
    totals = own.groupBy("symbol", SEGMENT).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in columns.items()])
    before = Window.partitionBy("symbol").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("symbol", SEGMENT, *[F.sum(f"_t_{o}").over(before).alias(f"_c_{o}") for o in columns])
    run = Window.partitionBy("symbol", SEGMENT).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(carry, ["symbol", SEGMENT], "left")
    for o, c in columns.items():
        out = out.withColumn(o, F.when(
            F.col(c).isNotNull(), F.sum(c).over(run) + F.coalesce(f"_c_{o}", F.lit(0.0)))).drop(f"_c_{o}")
    return out.drop(SEGMENT)
