"""Incremental ingestion as table work: merge, inventory, gaps, plans, gates and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.guards import div
from candlewick.functions.windows import over


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both, one row per (symbol, ts), the later batch winning; `date` is refreshed. An aggregate, so it combines
    before the shuffle."""
    cols = [c for c in old.columns if c not in ("symbol", "ts", "date")]
    rows = old.drop("date").withColumn("_b", F.lit(0)).unionByName(new.drop("date").withColumn("_b", F.lit(1)))
    best = rows.groupBy("symbol", "ts").agg(F.max_by(F.struct(*cols), "_b").alias("r"))
    return best.select("symbol", "ts", "r.*", F.to_date("ts").alias("date"))


def last_bar_date(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max(F.to_date("ts")).alias("last_date"))


def collection_plan(universe: DataFrame, bars: DataFrame, as_of: str, full_days: int = 365) -> DataFrame:
    """(symbol, category) universe to work items: full, incremental or up to date, with days and priority."""
    behind = F.datediff(F.lit(as_of).cast("date"), "last_date")
    out = universe.join(last_bar_date(bars), "symbol", "left").withColumn("days_behind", behind)
    mode = F.when(F.col("last_date").isNull(), "full").when(F.col("days_behind") <= 1, "up_to_date").otherwise("incremental")
    days = F.when(F.col("last_date").isNull(), full_days).when(F.col("days_behind") <= 1, 0).otherwise(
        F.least(F.col("days_behind") + 2, F.lit(full_days)))
    return out.withColumns({"mode": mode, "days": days, "priority": F.when(F.col("category") == "major", 1).otherwise(2)}).orderBy(
        "priority", "symbol")


def data_inventory(universe: DataFrame, bars: DataFrame, as_of: str, full_days: int = 365) -> DataFrame:
    """Span, count, age and the missing range of every asset."""
    now = F.lit(as_of).cast("date")
    span = bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"),
                                      F.count(F.lit(1)).alias("bars"))
    out = universe.select("symbol").join(span, "symbol", "left").fillna(0, ["bars"])
    age = F.datediff(now, "last_date")
    start = F.coalesce(F.date_add("last_date", 1), F.date_sub(now, full_days))
    stale = F.coalesce(age >= 1, F.lit(True))
    ranges = F.when(stale, F.array(F.struct(start.alias("start"), now.alias("end")))).otherwise(
        F.array().cast("array<struct<start:date,end:date>>"))
    return out.withColumns({"days_since_last": age, "needs_update": stale, "missing_ranges": ranges})


def gap_ranges(bars: DataFrame) -> DataFrame:
    """Calendar ranges without bars inside each series: from the day after a bar to the day before the next one."""
    days = bars.select("symbol", F.to_date("ts").alias("ts")).distinct()
    nxt = F.lead("ts").over(over(days).w)
    gap = F.datediff("_next", "ts") - 1
    return days.withColumn("_next", nxt).filter(gap > 0).select(
        "symbol", F.date_add("ts", 1).alias("start"), F.date_sub("_next", 1).alias("end"), gap.alias("days"))


def update_plan(inventory: DataFrame, most: int = 30, default: int = 7) -> DataFrame:
    """Stale assets with total missing days, priority and the days to fetch."""
    total = F.aggregate("missing_ranges", F.lit(0), lambda a, r: a + F.datediff(r["end"], r["start"]) + 1)
    latest = F.array_max(F.transform("missing_ranges", lambda r: F.datediff(r["end"], r["start"]) + 1))
    age = F.col("days_since_last")
    return inventory.filter("needs_update").select(
        "symbol", total.alias("total_days"), F.when(age.isNull(), 1).when(age <= 7, 2).otherwise(3).alias("priority"),
        F.coalesce(F.least(latest, F.lit(most)), F.lit(default)).alias("days_needed")).orderBy("priority", "symbol")


def bulk_load_set(inventory: DataFrame) -> DataFrame:
    """Assets without data or in need of an update."""
    return inventory.filter((F.col("bars") == 0) | F.col("needs_update")).select("symbol")


def quality_gate(bars: DataFrame, assets: DataFrame, bar_reports: DataFrame, meta_reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars to store (usable bars) and metadata to store (bars and metadata both usable)."""
    good = bar_reports.filter("is_usable").select("symbol")
    both = good.join(meta_reports.filter("is_usable").select("symbol"), "symbol", "left_semi")
    return bars.join(good, "symbol", "left_semi"), assets.join(both, "symbol", "left_semi")


def collection_stats(results: DataFrame) -> DataFrame:
    """Totals over (symbol, status, points): processed, succeeded, success rate, points; the failed ones stay a table."""
    ok = F.col("status") == "ok"
    return results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
                       div(F.count_if(ok), F.count(F.lit(1))).alias("success_rate"), F.sum("points").alias("points"))


def failed_symbols(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") != "ok").select("symbol")


def rate(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(div(a, b), F.lit(0.0))


def ingestion_rates(runs: DataFrame) -> DataFrame:
    """Success, quality and storage shares in percent and the pace of each run."""
    return runs.select("run", (100 * rate("succeeded", "requested")).alias("success_pct"), (100 * rate("usable", "succeeded")).alias("quality_pct"),
                       (100 * rate("stored", "usable")).alias("storage_pct"), rate("points", "seconds").alias("points_per_second"),
                       (60 * rate("succeeded", "seconds")).alias("symbols_per_minute"), rate("megabytes", "stored").alias("mb_per_symbol"))


def latest_window(bars: DataFrame, symbols: DataFrame, as_of: str, days: int) -> DataFrame:
    """The last `days` of bars of the wanted symbols, with a flag for the ones to refresh first."""
    now = F.lit(as_of).cast("timestamp_ntz")
    age = bars.groupBy("symbol").agg((F.datediff(now, F.max("ts")) >= 1).alias("stale"))
    tail = bars.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    return tail.join(symbols.select("symbol"), "symbol", "left_semi").join(age, "symbol")


def ingestion_summary(runs: DataFrame) -> DataFrame:
    """Nested summary per run."""
    pick = lambda *c: F.struct(*c)
    return runs.select("run", pick("requested", "succeeded", "points").alias("collection"), pick("usable").alias("quality"),
                       pick("stored", "megabytes").alias("storage"), pick("seconds").alias("performance"))


def ingestion_history(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("run")).limit(n)


