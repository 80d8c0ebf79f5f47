"""Streaming operators on a trade tape (ts, trade_id, symbol, price, size, side).

Bars and features are built-in windowed aggregates with a watermark, so state is bounded by the window plus the allowed
delay. Sinks write to the shared folder with a checkpoint beside them; batch handlers are idempotent by batch id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from candlewick.operators.ingestion import merge_bars
from candlewick.sources.files import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_trades(spark: SparkSession, folder: str, schema, name: str = "*", per_batch: int | None = None) -> DataFrame:
    """Stream of the trade files of a folder, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def with_event_time(trades: DataFrame, delay: str) -> DataFrame:
    """Watermarks need an instant, so the zone-less time is cast."""
    return trades.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _bars(trades: DataFrame, window) -> DataFrame:
    key = F.struct("ts", "trade_id")
    return trades.groupBy(window, "symbol").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades")).select(
            "symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), F.col("window.end").cast("timestamp_ntz").alias("end_ts"),
            "open", "high", "low", "close", "volume", "trades")


def trades_to_bars(trades: DataFrame, length: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Tumbling bars; a bar is final once the watermark passes its end."""
    return _bars(with_event_time(trades, delay), F.window("ts", length))


def rolling_bar_features(trades: DataFrame, length: str = "4 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Overlapping windows."""
    return _bars(with_event_time(trades, delay), F.window("ts", length, slide))


def dedup_trades(trades: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a trade id arriving within the delay; state holds only ids younger than that."""
    return with_event_time(trades, delay).dropDuplicatesWithinWatermark(["trade_id"])


def stale_gaps(trades: DataFrame, key: str = "symbol", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of activity: each closed session ends where its key fell silent for longer than the gap."""
    s = with_event_time(trades, delay)
    return s.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("trades")).select(
        key, F.col("session_window.start").cast("timestamp_ntz").alias("start_ts"), F.col("session_window.end").cast("timestamp_ntz").alias("stale_from"),
        "trades")


class OnlineState(StatefulProcessor):
    """Decayed mean and signed volume per symbol, carried across batches as four numbers."""

    def __init__(self, span: int):
        self.decay = 1.0 - 2.0 / (span + 1.0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "num double, den double, obv double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        num, den, obv, last = held if held is not None else (0.0, 0.0, 0.0, None)
        out = []
        frame = pd.concat(list(rows)).sort_values(["ts", "trade_id"])
        for ts, tid, price, size in zip(frame["ts"], frame["trade_id"], frame["price"], frame["size"]):
            num, den = price + self.decay * num, 1.0 + self.decay * den
            obv = size if last is None else obv + size * ((price > last) - (price < last))
            last = price
            out.append((key[0], ts, tid, num / den, obv))
        self.state.update((num, den, obv, last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "trade_id", "ema", "obv"])

    def close(self) -> None:
        pass


def online_ema(trades: DataFrame, span: int = 12) -> DataFrame:
    """Decayed mean and on-balance volume at every trade, with keyed state (needs the RocksDB state store).

    One symbol's trades are sequential by definition; a batch bounds what a task holds.
    """
    rows = trades.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "trade_id", "price", "size")
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=OnlineState(span), outputStructType="symbol string, ts timestamp, trade_id long, ema double, obv double",
        outputMode="Append", timeMode="None")


def run_to_table(stream: DataFrame, label: str, mode: str = "append", partition: tuple[str, ...] = ()) -> str:
    """Process everything available into Parquet under a fresh shared folder; returns the folder."""
    root = scratch(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.start(f"{root}/data").awaitTermination()
    return f"{root}/data"


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int, str], None]) -> str:
    """Process everything available through a batch handler given (rows, batch id, folder)."""
    root = scratch(stream.sparkSession, label)
    query = stream.writeStream.foreachBatch(lambda df, i: handle(df, i, root)).option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return root


def split_late(delay: str = "1 hour") -> Callable[[DataFrame, int, str], None]:
    """Batch handler: rows more than `delay` behind the newest time of earlier batches go to `late`, the rest to `fresh`.

    The newest time is kept as a one-row table per batch, so a restarted query decides the same way.
    """

    def handle(df: DataFrame, batch: int, root: str) -> None:
        spark = df.sparkSession
        newest = F.lit(None).cast("timestamp")
        if batch > 0:
            newest = spark.read.schema("newest timestamp").parquet(f"{root}/newest/batch={batch - 1}").agg(F.max("newest")).scalar()
        rows = df.withColumn("_late", F.coalesce(F.col("ts").cast("timestamp") < newest - F.expr(f"interval {delay}"), F.lit(False)))
        for name, part in (("late", rows.filter("_late")), ("fresh", rows.filter("NOT _late"))):
            part.drop("_late").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        top = df.agg(F.max(F.col("ts").cast("timestamp")).alias("t")).select(F.greatest("t", newest).alias("newest"))
        top.write.mode("overwrite").parquet(f"{root}/newest/batch={batch}")

    return handle


def upsert_batches() -> Callable[[DataFrame, int, str], None]:
    """Batch handler: merge the batch's bars into the table; each batch writes the next version, so a retry repeats it exactly."""

    def handle(df: DataFrame, batch: int, root: str) -> None:
        rows = df.dropDuplicates(["symbol", "ts"])
        if batch > 0:
            rows = merge_bars(df.sparkSession.read.parquet(f"{root}/version={batch - 1}"), rows).drop("date")
        rows.write.mode("overwrite").parquet(f"{root}/version={batch}")

    return handle


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """The last merged table; the version is a partition column, so only its files are read."""
    df = spark.read.option("basePath", root).parquet(f"{root}/version=*")
    return df.filter(F.col("version") == df.agg(F.max("version")).scalar()).drop("version")
