"""Several batches against the batch result."""

import datetime as dt
import random

from pyspark.sql import functions as F

from candlewick.sources.files import scratch
from candlewick.streaming import trades as st

SCHEMA = "trade_id long, ts timestamp_ntz, symbol string, price double, size double"


def tape(spark, n=600):
    r = random.Random(2)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i), r.choice("AB"), float(r.randint(1, 99)), float(r.randint(1, 9))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def in_three_files(df):
    folder = scratch(df.sparkSession, "tape")
    for k in range(3):
        df.filter((F.col("trade_id") >= 200 * k) & (F.col("trade_id") < 200 * (k + 1))).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_bars_over_several_batches(spark):
    df = tape(spark)
    stream = st.read_trades(spark, in_three_files(df), df.schema, "*.parquet", 1)
    got = {(r["symbol"], r["ts"]): r for r in spark.read.parquet(st.run_to_table(st.trades_to_bars(stream, "10 minutes", "1 minute"), "t")).collect()}
    pdf = df.toPandas().sort_values(["ts", "trade_id"])
    cut = pdf["ts"].max() - dt.timedelta(minutes=1)
    want = 0
    for (symbol, start), g in pdf.groupby(["symbol", pdf["ts"].dt.floor("10min")]):
        if start + dt.timedelta(minutes=10) > cut:
            continue
        want += 1
        row = got[symbol, start.to_pydatetime()]
        assert (row["open"], row["close"], row["high"], row["low"], row["volume"]) == (
            g["price"].iloc[0], g["price"].iloc[-1], g["price"].max(), g["price"].min(), g["size"].sum())
    assert len(got) == want > 10


def test_late_rows_are_counted_apart(spark):
    df = tape(spark)
    folder = scratch(spark, "late")
    early = F.col("trade_id") < 100
    df.filter(~early).coalesce(1).write.parquet(folder)
    df.filter(early).coalesce(1).write.mode("append").parquet(folder)
    root = st.run_batches(st.read_trades(spark, folder, df.schema, "*.parquet", 1), "late", st.split_late("1 hour"))
    assert spark.read.parquet(f"{root}/late").count() == 100 and spark.read.parquet(f"{root}/fresh").count() == 500


def test_upsert_keeps_the_last_version(spark):
    old = spark.createDataFrame([("A", dt.datetime(2024, 1, i), 1.0) for i in (1, 2)], "symbol string, ts timestamp_ntz, close double")
    new = spark.createDataFrame([("A", dt.datetime(2024, 1, i), 9.0) for i in (2, 3)], "symbol string, ts timestamp_ntz, close double")
    folder = scratch(spark, "up")
    old.coalesce(1).write.parquet(folder)
    new.coalesce(1).write.mode("append").parquet(folder)
    root = st.run_batches(st.read_trades(spark, folder, old.schema, "*.parquet", 1), "up", st.upsert_batches())
    assert [r["close"] for r in st.newest_version(spark, root).orderBy("ts").collect()] == [1.0, 9.0, 9.0]
