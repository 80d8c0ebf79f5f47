"""Queries S1-S8: the events table read as a trade stream and processed to the end; append mode leaves open windows out."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.plans.registry import register
from candlewick.plans.sqltext import EVENT, TRADES, ctes, decay, lag, tidy
from candlewick.sources.files import scratch
from candlewick.sources.market import event_bars, live_trades, table
from candlewick.streaming import trades as st


def tape(spark, d):
    """Streaming form of `live_trades`."""
    schema = table(spark, d, "events").schema
    raw = st.read_trades(spark, d, schema, "events.parquet")
    return raw.filter(F.col("value") > 0).select(
        F.col("event_id").alias("trade_id"), "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), "user_id")


def table_of(spark, stream, label):
    return spark.read.parquet(st.run_to_table(stream, label))


WM = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM trades)"
FOLD = """SELECT symbol, ts, end_ts, first(price ORDER BY t, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY t, trade_id) AS close,
    sum(size) AS volume, count(*) AS trades FROM ({src}) GROUP BY symbol, ts, end_ts HAVING end_ts <= """ + WM
register("S1_trades_to_bars", lambda spark, d: rounded(table_of(spark, st.trades_to_bars(tape(spark, d), "1 hour"), "bars")), ctes(
    FOLD.format(src="SELECT symbol, date_trunc('hour', ts) AS ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_ts, ts AS t, trade_id, price, size FROM trades"), trades=TRADES))


def _dedup(spark, d):
    twice = tape(spark, d).withColumn("copy", F.explode(F.when(F.col("trade_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return table_of(spark, st.dedup_trades(twice.drop("copy")), "dedup").select("trade_id", "symbol", "price", "size")


register("S2_dedup_trades", _dedup, ctes("SELECT trade_id, symbol, price, size FROM trades", trades=TRADES))
register("S3_rolling_bar_features", lambda spark, d: rounded(table_of(spark, st.rolling_bar_features(tape(spark, d)), "rolling")), ctes(
    FOLD.format(src="""SELECT symbol, date_trunc('hour', ts) - to_hours(CAST(k AS BIGINT)) AS ts, date_trunc('hour', ts) - to_hours(CAST(k AS BIGINT)) + INTERVAL 4 HOUR AS end_ts,
    ts AS t, trade_id, price, size FROM trades, range(4) r(k)"""), trades=TRADES))


def _two_files(rows, first, label):
    """Write two files in order: the rows of `first`, then the others."""
    folder = scratch(rows.sparkSession, label)
    rows.filter(first).coalesce(1).write.parquet(folder)
    rows.filter(~first).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _late(spark, d):
    rows = live_trades(spark, d).select("trade_id", "ts", "symbol", "price", "size")
    folder = _two_files(rows, F.col("trade_id") % 3 != 0, "late-in")
    root = st.run_batches(st.read_trades(spark, folder, rows.schema, "*.parquet", 1), "late", st.split_late("12 hours"))
    read = lambda n: spark.read.parquet(f"{root}/{n}").groupBy("symbol").agg(F.count(F.lit(1)).alias(n))
    return read("fresh").join(read("late"), "symbol", "full").fillna(0, ["fresh", "late"])


register("S4_late_trades", _late, ctes(
    """SELECT symbol, count_if(trade_id % 3 <> 0 OR ts >= cut) AS fresh, count_if(trade_id % 3 = 0 AND ts < cut) AS late FROM trades,
    (SELECT max(ts) - INTERVAL 12 HOUR AS cut FROM trades WHERE trade_id % 3 <> 0) GROUP BY symbol""", trades=TRADES))
register("S5_stream_staleness", lambda spark, d: table_of(spark, st.stale_gaps(tape(spark, d), "user_id"), "stale"), ctes(
    f"""SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS stale_from, count(*) AS trades FROM (
    SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, trade_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, trade_id) + INTERVAL 30 MINUTE
    THEN 1 ELSE 0 END AS brk FROM trades)) GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= {WM}""", trades=TRADES))


def _ema(spark, d):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    try:
        out = table_of(spark, st.online_ema(tape(spark, d)), "ema")
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return rounded(out.select("symbol", "trade_id", "ema", "obv"))


# the recursion of the batch twin needs a total order, so trades are numbered by (ts, trade_id)
EMA = decay("ordered", "price", span=12, name="ema")
register("S6_online_ema", _ema, ctes(
    f"""SELECT o.symbol, trade_id, {tidy('ema')} AS ema, {tidy('sum(f) OVER (PARTITION BY o.symbol ORDER BY o.ts)')} AS obv FROM (SELECT *, CASE WHEN {lag('price')} IS NULL THEN size
    ELSE sign(price - {lag('price')}) * size END AS f FROM ordered) o JOIN v_ema v ON v.symbol = o.symbol AND v.ts = o.ts""",
    trades=TRADES, ordered="SELECT symbol, trade_id, price, size, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS ts FROM trades", **EMA))


def _sink(spark, d):
    bars = st.trades_to_bars(tape(spark, d), "1 hour").withColumn("date", F.to_date("ts"))
    path = st.run_to_table(bars, "sink", partition=("symbol", "date"))
    return spark.read.parquet(path).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("bars"), F.sum("trades").alias("trades"))


register("S7_bars_sink", _sink, ctes(
    "SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS bars, CAST(sum(trades) AS BIGINT) AS trades FROM (" + FOLD.format(
        src="SELECT symbol, date_trunc('hour', ts) AS ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_ts, ts AS t, trade_id, price, size FROM trades")
    + ") GROUP BY symbol, CAST(ts AS DATE)", trades=TRADES))


def _upsert(spark, d):
    b = event_bars(spark, d).select("symbol", "ts", "close", "volume").withColumn("late", F.lit(False))
    fixed = b.filter(F.hour("ts") % 6 == 0).withColumns({"close": F.col("close") + 100, "late": F.lit(True)})
    rows = b.filter(F.hour("ts") % 5 != 1).unionByName(fixed)
    folder = _two_files(rows, ~F.col("late"), "upsert-in")
    root = st.run_batches(st.read_trades(spark, folder, rows.schema, "*.parquet", 1), "upsert", st.upsert_batches())
    return st.newest_version(spark, root).select("symbol", "ts", "close", "volume")


register("S8_merge_stream", _upsert, ctes(
    "SELECT symbol, ts, CASE WHEN hour(ts) % 6 = 0 THEN close + 100 ELSE close END AS close, volume FROM bars WHERE hour(ts) % 5 <> 1 OR hour(ts) % 6 = 0", bars=EVENT))
