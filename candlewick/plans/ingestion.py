"""Queries B1-B11: incremental ingestion over daily supplier bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import ingestion as ing
from candlewick.operators import quality as q
from candlewick.plans.quality import NOW, REPORT, reports_of
from candlewick.plans.registry import register
from candlewick.plans.sqltext import ASSETS, SUPPLIER, W, ctes, rnd
from candlewick.sources.market import assets, dirty_bars, supplier_bars, table

AS_OF = "2001-11-05"
COLS = ("symbol", "ts", "close", "volume")


def _merge(spark, d):
    b = supplier_bars(spark, d).select(*COLS)
    late = b.filter(F.col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    new = late.filter(F.dayofmonth("ts") % 2 == 0).withColumn("close", F.col("close") + 1).unionByName(
        late.filter(F.dayofmonth("ts") == 1).withColumn("ts", F.col("ts") + F.expr("interval 12 hours")))
    return ing.merge_bars(b, new)


register("B1_merge_bars", _merge, ctes(
    """SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '2000-01-01' AND day(ts) % 2 = 0 THEN close + 1 ELSE close END AS close, volume, CAST(ts AS DATE) AS date FROM bars
    UNION ALL SELECT symbol, ts + INTERVAL 12 HOUR, close, volume, CAST(ts AS DATE) FROM bars WHERE ts >= TIMESTAMP '2000-01-01' AND day(ts) = 1""", bars=SUPPLIER))
register("B2_last_bar_date", lambda spark, d: ing.last_bar_date(supplier_bars(spark, d)),
         ctes("SELECT symbol, CAST(max(ts) AS DATE) AS last_date FROM bars GROUP BY symbol", bars=SUPPLIER))


def universe(spark, d):
    """All assets plus, for every tenth supplier, one listed asset that has no bars yet."""
    a = assets(spark, d).select("symbol", F.when(F.col("market_cap_usd") > 1e8, "major").otherwise("altcoin").alias("category"))
    fresh = table(spark, d, "supplier").filter(F.col("s_suppkey") % 10 == 0).select(
        F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("symbol"), F.lit("altcoin").alias("category"))
    return a.unionByName(fresh)


U = {"bars": SUPPLIER, "assets": ASSETS,
     "uni": """SELECT symbol, CASE WHEN market_cap_usd > 1e8 THEN 'major' ELSE 'altcoin' END AS category FROM assets UNION ALL
         SELECT 'N' || s_suppkey, 'altcoin' FROM supplier WHERE s_suppkey % 10 = 0""",
     "span": "SELECT symbol, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date, count(*) AS bars FROM bars GROUP BY symbol",
     "inv": f"""SELECT symbol, first_date, last_date, coalesce(bars, 0) AS bars, CAST(date_diff('day', last_date, DATE '{AS_OF}') AS INTEGER) AS days_since_last,
         coalesce(date_diff('day', last_date, DATE '{AS_OF}') >= 1, true) AS needs_update,
         CAST(coalesce(last_date + 1, DATE '{AS_OF}' - 365) AS DATE) AS range_start FROM uni LEFT JOIN span USING (symbol)"""}
register("B3_collection_plan", lambda spark, d: ing.collection_plan(universe(spark, d), supplier_bars(spark, d), AS_OF), ctes(
    """SELECT symbol, category, last_date, behind AS days_behind, CASE WHEN last_date IS NULL THEN 'full' WHEN behind <= 1 THEN 'up_to_date' ELSE 'incremental' END AS mode,
    CASE WHEN last_date IS NULL THEN 365 WHEN behind <= 1 THEN 0 ELSE least(behind + 2, 365) END AS days, CASE WHEN category = 'major' THEN 1 ELSE 2 END AS priority
    FROM (SELECT symbol, category, last_date, days_since_last AS behind FROM uni JOIN inv USING (symbol))""", **U))


def inventory_of(spark, d):
    return ing.data_inventory(universe(spark, d), supplier_bars(spark, d), AS_OF)


register("B4_data_inventory", lambda spark, d: inventory_of(spark, d).select(
    "symbol", "first_date", "last_date", "bars", "days_since_last", "needs_update", F.get("missing_ranges", F.lit(0)).getField("start").alias("range_start")), ctes(
    "SELECT * FROM inv", **U))
register("B5_gap_ranges", lambda spark, d: ing.gap_ranges(supplier_bars(spark, d)), ctes(
    f"""SELECT symbol, CAST(ts + INTERVAL 1 DAY AS DATE) AS start, CAST(nx - INTERVAL 1 DAY AS DATE) AS "end", CAST(date_diff('day', ts, nx) - 1 AS INTEGER) AS days FROM (
    SELECT symbol, ts, lead(ts) OVER {W} AS nx FROM bars) WHERE date_diff('day', ts, nx) > 1""", bars=SUPPLIER))
register("B6_update_plan", lambda spark, d: ing.update_plan(inventory_of(spark, d)), ctes(
    f"""SELECT symbol, CAST(n AS INTEGER) AS total_days, CASE WHEN days_since_last IS NULL THEN 1 WHEN days_since_last <= 7 THEN 2 ELSE 3 END AS priority,
    CAST(least(n, 30) AS INTEGER) AS days_needed FROM (SELECT *, date_diff('day', range_start, DATE '{AS_OF}') + 1 AS n FROM inv WHERE needs_update)""", **U))
register("B6_bulk_load_set", lambda spark, d: ing.bulk_load_set(inventory_of(spark, d)), ctes("SELECT symbol FROM inv WHERE bars = 0 OR needs_update", **U))


def _gate(spark, d):
    b, a = dirty_bars(spark, d), assets(spark, d)
    bars, meta = ing.quality_gate(b, a, reports_of(spark, d), q.report(q.meta_checks(a, NOW)))
    kept = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    return kept.join(meta.select("symbol", F.lit(True).alias("metadata")), "symbol", "left").fillna(False, ["metadata"])


PRESENT = ("((market_cap_usd IS NOT NULL)::INT + (daily_volume_brl IS NOT NULL)::INT + (listing_date IS NOT NULL)::INT + (sector IS NOT NULL)::INT)")
BAD = f"coalesce((listing_date > TIMESTAMP '{NOW}' OR listing_date < TIMESTAMP '2009-01-01')::INT, 0)"
register("B7_quality_gate", _gate, ctes(
    f"""SELECT symbol, count(*) AS bars, any_value(ok) AS metadata FROM bars JOIN (SELECT symbol FROM reports WHERE is_usable) USING (symbol) JOIN (
    SELECT symbol, ((0.7 + 0.3 * {PRESENT} / 4) * 0.25 + (1 - 0.25 * {BAD}) * CASE WHEN {BAD} > 0 THEN 0.35 ELSE 0.25 END + 0.25) / (0.5 + CASE WHEN {BAD} > 0 THEN 0.35 ELSE 0.25 END) >= 0.7 AS ok FROM assets) USING (symbol) GROUP BY symbol""",
    **REPORT, assets=ASSETS))


def results(spark, d):
    n = supplier_bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return universe(spark, d).join(n, "symbol", "left").select("symbol", F.when(F.col("n") > 520, "ok").otherwise("failed").alias("status"),
                                                               F.coalesce("n", F.lit(0)).alias("points"))


RES = {**U, "res": "SELECT symbol, CASE WHEN bars > 520 THEN 'ok' ELSE 'failed' END AS status, bars AS points FROM inv"}
register("B8_collection_stats", lambda spark, d: rounded(ing.collection_stats(results(spark, d))), ctes(
    """SELECT count(*) AS processed, count_if(status = 'ok') AS succeeded, count_if(status <> 'ok') AS failed, round(count_if(status = 'ok') / CAST(count(*) AS DOUBLE) + 1e-9, 6) AS success_rate,
    CAST(sum(points) AS BIGINT) AS points FROM res""", **RES))
register("B8_failed_symbols", lambda spark, d: ing.failed_symbols(results(spark, d)), ctes("SELECT symbol FROM res WHERE status <> 'ok'", **RES))


def runs(spark, d):
    """One ingestion run per order day."""
    o = table(spark, d, "orders")
    s = F.col("o_orderstatus")
    return o.groupBy(F.to_date("o_orderdate").alias("run")).agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(s != "P").alias("succeeded"), F.count_if(s == "F").alias("usable"),
        F.count_if((s == "F") & (F.col("o_orderkey") % 2 == 0)).alias("stored"), F.sum(F.col("o_orderkey") % 100).alias("points"),
        F.sum(F.col("o_orderkey") % 7).alias("seconds"), (F.count(F.lit(1)) * 0.5).cast("double").alias("megabytes"))


RUNS = {"runs": """SELECT CAST(o_orderdate AS DATE) AS run, count(*) AS requested, count_if(o_orderstatus <> 'P') AS succeeded, count_if(o_orderstatus = 'F') AS usable,
    count_if(o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS stored, CAST(sum(o_orderkey % 100) AS BIGINT) AS points, CAST(sum(o_orderkey % 7) AS BIGINT) AS seconds,
    CAST(count(*) * 0.5 AS DOUBLE) AS megabytes FROM orders GROUP BY 1"""}
register("B9_ingestion_rates", lambda spark, d: rounded(ing.ingestion_rates(runs(spark, d))), ctes(
    f"""SELECT run, {rnd('success_pct quality_pct storage_pct points_per_second symbols_per_minute mb_per_symbol')} FROM (
    SELECT run, coalesce(100.0 * succeeded / nullif(requested, 0), 0) AS success_pct, coalesce(100.0 * usable / nullif(succeeded, 0), 0) AS quality_pct,
    coalesce(100.0 * stored / nullif(usable, 0), 0) AS storage_pct, coalesce(points / CAST(nullif(seconds, 0) AS DOUBLE), 0) AS points_per_second,
    coalesce(60.0 * succeeded / nullif(seconds, 0), 0) AS symbols_per_minute, coalesce(megabytes / nullif(stored, 0), 0) AS mb_per_symbol FROM runs)""", **RUNS))
register("B10_latest_window", lambda spark, d: ing.latest_window(supplier_bars(spark, d), assets(spark, d).filter("is_active"), AS_OF, 365).select(
    "symbol", "ts", "close", "stale"), ctes(
    f"""SELECT symbol, ts, close, date_diff('day', m, TIMESTAMP '{AS_OF}') >= 1 AS stale FROM bars JOIN (SELECT symbol, max(ts) AS m FROM bars GROUP BY symbol) USING (symbol)
    WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND symbol IN (SELECT symbol FROM assets WHERE is_active)""", bars=SUPPLIER, assets=ASSETS))
register("B11_ingestion_summary", lambda spark, d: ing.ingestion_summary(runs(spark, d)).select(
    "run", "collection.requested", "collection.points", "quality.usable", "storage.stored", "performance.seconds"), ctes(
    "SELECT run, requested, points, usable, stored, seconds FROM runs", **RUNS))
register("B11_ingestion_history", lambda spark, d: ing.ingestion_history(runs(spark, d)), ctes("SELECT * FROM runs ORDER BY run DESC LIMIT 10", **RUNS))
