"""Queries A1-A24: file and payload sources. Files are written from the given tables to a fresh shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick import schemas
from candlewick.functions.guards import rounded
from candlewick.operators import cleaning as cl
from candlewick.plans.cleaning import SEGMENTS, WIDE
from candlewick.plans.registry import register
from candlewick.plans.sqltext import ASSETS, EVENT, SEGMENT, SUPPLIER, TRADES, ctes, lag, rnd, tidy
from candlewick.sources import files as fl
from candlewick.sources import payloads as pl
from candlewick.sources.market import assets, event_bars, live_trades, segment_bars, supplier_bars, table

OHLCV = ("symbol", "ts", "open", "high", "low", "close", "volume", "quote_volume")
EV = f"SELECT {', '.join(OHLCV)} FROM bars"


def _csv(spark, d):
    root = fl.scratch(spark, "csv")
    fl.sink_bars_csv(event_bars(spark, d), root, ["click", "view"])
    return fl.scan_bars_csv(spark, root).select(*OHLCV)


register("A1_scan_bars_csv", _csv, ctes(EV, bars=EVENT))


def _price_csv(spark, d):
    path = fl.scratch(spark, "price")
    event_bars(spark, d).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"), "symbol", "close", "volume").write.option("header", True).csv(path)
    return fl.scan_price_csv(spark, path)


register("A2_scan_price_csv", _price_csv, ctes("SELECT symbol, ts, close, volume FROM bars", bars=EVENT))
register("A3_require_columns", lambda spark, d: schemas.require_columns(supplier_bars(spark, d), ["symbol", "ts", "close"]).select(*OHLCV),
         ctes(EV, bars=SUPPLIER))


def _universe(spark, d):
    path = fl.scratch(spark, "universe")
    big = F.col("market_cap_usd") > 1e8
    names = lambda c: F.collect_list(F.when(c, F.col("symbol")))
    doc = assets(spark, d).agg(F.to_json(F.struct(F.struct(names(big).alias("major_crypto"), names(~big).alias("altcoins")).alias("categories"))).alias("value"))
    doc.coalesce(1).write.text(path)
    return fl.scan_universe_json(spark, path)


register("A4_scan_universe_json", _universe, ctes(
    "SELECT symbol, CASE WHEN market_cap_usd > 1e8 THEN 'major' ELSE 'altcoin' END AS category FROM assets", assets=ASSETS))


def candle_payloads(spark, d):
    """One JSON payload per supplier; every seventh misses a value in one array, every eleventh has a bad number."""
    b = supplier_bars(spark, d)
    k = F.col("symbol").cast("long")
    arr = F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"),
                                               F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))))
    per = b.groupBy("symbol").agg(arr.alias("a"))
    o = F.when(k % 7 == 3, F.slice("a.o", 2, F.size("a") - 1)).otherwise(F.col("a.o")).cast("array<string>")
    v = F.transform(F.col("a.v").cast("array<string>"), lambda x, i: F.when((k % 11 == 5) & (i == 0), "n/a").otherwise(x))
    return per.select("symbol", F.to_json(F.struct(F.col("a.t").alias("t"), o.alias("o"), F.col("a.h").alias("h"), F.col("a.l").alias("l"),
                                                   F.col("a.c").alias("c"), v.alias("v"))).alias("payload"))


register("A5_parse_candle_json", lambda spark, d: rounded(pl.parse_candle_json(candle_payloads(spark, d)), 4, keep=("open", "high", "low", "close")), ctes(
    f"""SELECT symbol, ts, open, high, low, close, {tidy('volume', 4)} AS volume, {tidy('volume * close', 4)} AS quote_volume FROM (SELECT *, {lag('ts')} AS p FROM bars)
    WHERE CAST(symbol AS BIGINT) % 7 <> 3 AND NOT (CAST(symbol AS BIGINT) % 11 = 5 AND p IS NULL)""", bars=SUPPLIER))


def _pairs(spark, d):
    per = segment_bars(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("t"), "close", "volume"))).alias("a"))
    pair = lambda f: F.transform("a", lambda x: F.array(x["t"], x[f]))
    volumes = F.slice(pair("volume"), 1, F.size("a") - 3)
    return pl.parse_price_pairs_json(per.select("symbol", F.to_json(F.struct(pair("close").alias("prices"), volumes.alias("total_volumes"))).alias("payload")))


register("A6_parse_price_pairs_json", lambda spark, d: rounded(_pairs(spark, d), 4, keep=("open", "high", "low", "close")), ctes(
    f"""SELECT symbol, ts, close AS open, close AS high, close AS low, close, {tidy('v', 4)} AS volume, {tidy('v * close', 4)} AS quote_volume FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) > 3 THEN volume ELSE 0 END AS v FROM bars)""", bars=SEGMENT))
register("A7_normalize_vendor_bars", lambda spark, d: rounded(pl.normalize_vendor_bars(supplier_bars(spark, d).select(
    "symbol", "ts", *[F.col(c.lower()).alias(c) for c in ("Open", "High", "Low", "Close", "Volume")])), 4, keep=("open", "high", "low", "close")), ctes(
    f"SELECT symbol, ts, open, high, low, close, {tidy('volume', 4)} AS volume, {tidy('volume * close', 4)} AS quote_volume FROM bars", bars=SUPPLIER))
PAIRNAME = "CASE WHEN s_suppkey % 3 = 0 THEN '-BRL' WHEN s_suppkey % 3 = 1 THEN '-USDT' ELSE '-BRLX' END"


def _names(spark, d):
    k = F.col("s_suppkey") % 3
    return table(spark, d, "supplier").select(F.concat(F.col("s_name"), F.when(k == 0, "-BRL").when(k == 1, "-USDT").otherwise("-BRLX")).alias("pair"))


register("A8_filter_quote_pairs", lambda spark, d: pl.filter_quote_pairs(_names(spark, d)),
         f"SELECT pair, left(pair, length(pair) - 4) AS symbol FROM (SELECT s_name || {PAIRNAME} AS pair FROM supplier) WHERE pair LIKE '%-BRL'")
register("A9_symbol_id_map", lambda spark, d: pl.symbol_id_map(table(spark, d, "part").select(
    F.col("p_brand").alias("symbol"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey").cast("string")).otherwise("").alias("id"), "p_partkey"), "p_partkey"),
    "SELECT upper(p_brand) AS symbol, arg_max(CAST(p_partkey AS VARCHAR), p_partkey) AS id FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1")


def stored_bars(spark, d):
    path = fl.scratch(spark, "bars")
    fl.sink_bars_parquet(event_bars(spark, d), path)
    return path


register("A10_sink_bars_parquet", lambda spark, d: fl.scan_bars_parquet(spark, stored_bars(spark, d)).select(*OHLCV), ctes(EV, bars=EVENT))
register("A11_scan_bars_parquet", lambda spark, d: fl.scan_bars_parquet(
    spark, stored_bars(spark, d), ["click", "error"], "2024-01-05", "2024-01-12").select(*OHLCV), ctes(
    f"{EV} WHERE symbol IN ('click', 'error') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'", bars=EVENT))


def _snapshot(spark, d):
    path = fl.scratch(spark, "features")
    f = cl.asset_returns(supplier_bars(spark, d)).select("symbol", "ts", "returns")
    fl.sink_features(f.withColumn("returns", F.lit(0.0)), path, "20240101_000000")
    fl.sink_features(f, path, "20240102_000000")
    return rounded(fl.scan_latest_features(spark, path, start="1998-01-01").select("symbol", "ts", "returns"))


register("A12_latest_features", _snapshot, ctes(
    f"SELECT symbol, ts, {rnd('returns')} FROM (SELECT *, close / nullif({lag('close')}, 0) - 1 AS returns FROM bars) WHERE ts >= TIMESTAMP '1998-01-01'", bars=SUPPLIER))


def _upsert(spark, d):
    old = assets(spark, d)
    k = F.col("symbol").cast("long")
    new = old.filter(k % 2 == 0).withColumn("market_cap_usd", F.when(k % 4 == 0, F.col("market_cap_usd") + 1).otherwise(F.col("market_cap_usd"))).withColumn(
        "last_updated", F.lit("2024-02-01").cast("timestamp_ntz"))
    return pl.upsert_assets(old, new).select("symbol", "market_cap_usd", "last_updated", "changed")


register("A13_upsert_assets", _upsert, ctes(
    """SELECT symbol, CASE WHEN CAST(symbol AS BIGINT) % 4 = 0 THEN market_cap_usd + 1 ELSE market_cap_usd END AS market_cap_usd,
    CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN TIMESTAMP '2024-02-01' ELSE last_updated END AS last_updated, CAST(symbol AS BIGINT) % 4 = 0 AS changed FROM a""", a=ASSETS))
register("A14_scan_assets", lambda spark, d: pl.scan_assets(assets(spark, d), supplier_bars(spark, d).filter("volume > 100").select("symbol")).select(
    "symbol", "name", "market_cap_usd", "sector"), ctes(
    "SELECT symbol, name, market_cap_usd, sector FROM a WHERE symbol IN (SELECT symbol FROM bars WHERE volume > 100)", a=ASSETS, bars=SUPPLIER))
register("A15_asset_stats", lambda spark, d: rounded(pl.asset_stats(assets(spark, d)), 2), ctes(
    f"""SELECT count(*) AS assets, count_if(is_active) AS active, count(DISTINCT exchange) AS exchanges, count(DISTINCT sector) AS sectors,
    {tidy('avg(market_cap_usd)', 2)} AS avg_market_cap FROM a""", a=ASSETS))
register("A16_storage_stats", lambda spark, d: fl.storage_stats(spark, stored_bars(spark, d)).select("files", "symbols"), ctes(
    "SELECT count(DISTINCT (symbol, CAST(ts AS DATE))) AS files, count(DISTINCT symbol) AS symbols FROM bars", bars=EVENT))


def _portfolio(spark, d):
    t = fl.portfolio_tables(spark)
    trades = live_trades(spark, d).select(
        F.col("trade_id").alias("id"), "symbol", "side", F.col("size").alias("quantity"), "price", (F.col("price") * F.col("size")).alias("amount"),
        F.lit(0.0).alias("fees"), "ts", F.col("trade_id").cast("string").alias("order_id"), F.lit("filled").alias("execution_status"))
    return fl.table_counts({**t, "trades": t["trades"].unionByName(trades)})


register("A17_portfolio_stats", _portfolio, ctes(
    """SELECT 'trades' AS "table", count(*) AS rows FROM t UNION ALL SELECT 'positions', 0 UNION ALL SELECT 'performance', 0""", t=TRADES))
register("A18_bars_to_wide", lambda spark, d: cl.combine_assets(segment_bars(spark, d), SEGMENTS, ("close", "volume")), ctes(WIDE, bars=SEGMENT))


def _sources(spark, d):
    cols = ("symbol", "ts", "close")
    b = supplier_bars(spark, d).select(*cols)
    k = F.col("symbol").cast("long")
    a = b.filter(k % 3 == 0).withColumn("priority", F.lit(1))
    c = b.withColumn("close", F.col("close") + 1).withColumn("priority", F.lit(2))
    return pl.first_available_source(a.unionByName(c)).select(*cols, "priority")


register("A19_first_available_source", _sources, ctes(
    """SELECT symbol, ts, CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN close ELSE close + 1 END AS close,
    CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN 1 ELSE 2 END AS priority FROM bars""", bars=SUPPLIER))


def _metadata(spark, d):
    a = assets(spark, d)
    k = F.col("symbol").cast("long")
    cols = ("symbol", "name", "market_cap_usd", "daily_volume_brl", "is_active")
    one = a.filter(k % 3 != 1).select(*cols)
    two = a.filter(k % 4 != 2).select(*cols).withColumns({"market_cap_usd": F.when(k % 5 != 0, F.col("market_cap_usd") * 2), "name": F.upper("name")})
    return rounded(pl.merge_metadata(a, one, two), 2)


register("A20_merge_metadata", _metadata, ctes(
    f"""SELECT symbol, CASE WHEN fb THEN upper(name) WHEN fa THEN name ELSE symbol END AS name, {tidy('CASE WHEN fb THEN market_cap_usd * 2 WHEN fa THEN market_cap_usd END', 2)} AS market_cap_usd,
    {tidy('CASE WHEN fa THEN daily_volume_brl END', 2)} AS daily_volume_brl, CASE WHEN fa THEN is_active ELSE true END AS is_active, CASE WHEN fb THEN 'b' WHEN fa THEN 'a' ELSE 'minimal' END AS source
    FROM (SELECT *, k % 4 <> 2 AND k % 5 <> 0 AS fb, k % 3 <> 1 AS fa FROM (SELECT *, CAST(symbol AS BIGINT) AS k FROM a))""", a=ASSETS))
register("A21_complete_dataset_filter", lambda spark, d: pl.complete_dataset_filter(supplier_bars(spark, d), assets(spark, d), 1590).select("symbol", "ts", "close"), ctes(
    """SELECT symbol, ts, close FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 530)
    AND symbol IN (SELECT symbol FROM a WHERE is_active)""", a=ASSETS, bars=SUPPLIER))


def _vendor(spark, d):
    root = fl.scratch(spark, "vendor")
    event_bars(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close")).select(F.concat("symbol", F.lit("_data.csv")).alias("file"), F.date_format("day", "dd/MM/yyyy").alias("d"),
                                                      "open", "high", "low", "close").write.partitionBy("file").csv(root)
    return fl.concat_price_files(spark, [root])


register("A22_concat_price_files", lambda spark, d: _vendor(spark, d), ctes(
    """SELECT symbol, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM (SELECT symbol, b.ts, open, high, low, close FROM bars b)
    GROUP BY symbol, CAST(ts AS DATE)""".replace("arg_min(open, ts)", "arg_min(open, x.ts)").replace("arg_max(close, ts)", "arg_max(close, x.ts)").replace(
        "CAST(CAST(ts AS DATE) AS TIMESTAMP)", "CAST(CAST(x.ts AS DATE) AS TIMESTAMP)").replace("FROM bars b)\n", "FROM bars b) x\n").replace("GROUP BY symbol, CAST(ts AS DATE)", "GROUP BY symbol, CAST(x.ts AS DATE)"),
    bars=EVENT))


def _utf16(spark, d):
    path = fl.scratch(spark, "utf16")
    segment_bars(spark, d).select("symbol", F.date_format("ts", "yyyy.MM.dd HH:mm").alias("d"), "close").repartition("symbol").write.partitionBy("symbol").option(
        "encoding", "UTF-16").option("sep", "\t").csv(path)
    return fl.scan_utf16_tsv(spark, path)


register("A23_scan_utf16_tsv", _utf16, ctes("SELECT symbol, ts, close AS price FROM bars", bars=SEGMENT))


def _run_stats(spark, d):
    path = fl.scratch(spark, "stats")
    fl.sink_run_stats(supplier_bars(spark, d).agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol").alias("symbols"), F.max("ts").cast("string").alias("latest")), path)
    return spark.read.schema("bars long, symbols long, latest string").json(path)


register("A24_sink_run_stats", _run_stats, ctes(
    "SELECT count(*) AS bars, count(DISTINCT symbol) AS symbols, CAST(max(ts) AS VARCHAR) AS latest FROM bars", bars=SUPPLIER))
