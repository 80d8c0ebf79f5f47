"""As-of joins: each row with the newest row of another table at or before it, no older than a tolerance.

Both tables are stacked and sorted once per symbol; the newest right row is the last one not null. Nothing is joined on a range. A long symbol is cut into
stretches of time at least as long as the tolerance, so a right row can reach no further than the next stretch and is copied there; stretches are
sorted by different tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1_000_000


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, tolerance: float, columns: list[str], prefix: str = "other_", rows: int = ROWS) -> DataFrame:
    """left with `<prefix>ts` and `<prefix><column>` of the newest right row of its symbol at or before ts, at most `tolerance` seconds older; else null.

    Both have (symbol, ts). Of right rows with one symbol and ts the greatest by the listed columns counts. Left rows are kept as they
    are, repeated ones too; a null symbol or ts meets nothing.
    """
    reach = int(tolerance * 1_000_000)
    own = [c for c in left.columns if c not in ("symbol", "ts")]
    one = left.select("symbol", "ts", _micros("ts").alias("_t"), F.struct(*own).alias("_row"), F.lit(None).alias("_hit"))
    hit = F.struct(F.col("ts").alias("ts"), *columns)
    other = right.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull()).groupBy("symbol", "ts").agg(F.max(F.struct(*columns)).alias("_v")).select("symbol", "ts", "_v.*")
    other = other.select("symbol", "ts", _micros("ts").alias("_t"), F.lit(None).alias("_row"), hit.alias("_hit"))
    both = one.unionByName(other)
    # at most total / rows symbols are long
    span = both.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1")).filter(F.col("_n") > rows)
    width = F.greatest(F.lit(max(reach, 1)), F.ceil((F.col("_t1") - F.col("_t0") + 1) / F.ceil(F.col("_n") / rows)))
    placed = both.join(span.select("symbol", "_t0", width.alias("_w")), "symbol", "left")
    stretch = lambda t: F.coalesce(F.floor((t - F.col("_t0")) / F.col("_w")), F.lit(0))
    first, last = stretch(F.col("_t")), stretch(F.col("_t") + reach)
    dealt = placed.withColumn("_s", F.explode(F.when(F.col("_hit").isNull() | (first == last), F.array(first)).otherwise(F.array(first, last)))).drop("_t0", "_w")
    # at equal times the right row comes first
    order = Window.partitionBy("symbol", "_s").orderBy("_t", F.col("_hit").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("_seen", F.last("_hit", ignorenulls=True).over(order)).filter(F.col("_row").isNotNull())
    near = F.when(F.col("_t") - _micros("_seen.ts") <= reach, F.col("_seen"))
    named = seen.withColumn("_near", near)
    return named.select("symbol", "ts", "_row.*", F.col("_near.ts").alias(f"{prefix}ts"), *[F.col(f"_near.{c}").alias(f"{prefix}{c}") for c in columns])
