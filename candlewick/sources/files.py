"""File sources and sinks: bars, features, assets, run records. Schemas are stated; folders may be any Hadoop path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.schemas import BARS, PERFORMANCE, POSITIONS, TRADES
from candlewick.session import checkpoint_dir

NAME = r"([^/=]+)_data\.csv"
STAMP = "yyyy-MM-dd HH:mm:ss"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder on the shared storage."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def scan_bars_csv(spark: SparkSession, root: str, folders: tuple[str, ...] = ("major", "altcoins")) -> DataFrame:
    """Bars from every `<symbol>_data.csv` in the folders; unreadable rows are left out, no file at all is an error."""
    fields = [f for f in BARS.fields if f.name not in ("symbol", "source")] + [T.StructField("_corrupt", T.StringType())]
    raw = (spark.read.schema(T.StructType(fields)).option("header", True).option("recursiveFileLookup", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("timestampNTZFormat", STAMP)
           .csv([f"{root}/{f}" for f in folders]))
    if not raw.inputFiles():
        raise FileNotFoundError(f"no bar files under {root}")
    named = raw.withColumn("symbol", F.regexp_extract("_metadata.file_path", NAME, 1))
    return named.filter(F.col("_corrupt").isNull() & F.col("ts").isNotNull() & (F.col("symbol") != "")).drop("_corrupt")


def sink_bars_csv(bars: DataFrame, root: str, major: list[str]) -> None:
    """Write one `<symbol>_data.csv` per symbol into the two category folders, in one job per category."""
    named = bars.withColumn("file", F.concat("symbol", F.lit("_data.csv"))).select(
        "file", *[f.name for f in BARS.fields if f.name not in ("symbol", "source")])
    is_major = F.regexp_extract("file", NAME, 1).isin(major)
    for folder, rows in (("major", named.filter(is_major)), ("altcoins", named.filter(~is_major))):
        rows.write.partitionBy("file").option("header", True).option("timestampNTZFormat", STAMP).csv(f"{root}/{folder}")


def scan_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Prices whose time column is named timestamp, date or time; every column is read as text and cast."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    lower = {c.lower(): c for c in raw.columns}
    times = [F.try_to_timestamp(F.col(lower[t])).cast("timestamp_ntz") for t in ("timestamp", "date", "time") if t in lower]
    if not times:
        raise ValueError("no time column")
    values = [F.expr(f"try_cast(`{lower[v]}` AS double)").alias(v) for v in ("open", "high", "low", "close", "volume") if v in lower]
    keep = [F.col(lower["symbol"]).alias("symbol")] if "symbol" in lower else []
    return raw.select(*keep, F.coalesce(*times).alias("ts"), *values).dropna(subset=["ts"])


UNIVERSE = "categories struct<major_crypto: array<string>, altcoins: array<string>>"


def scan_universe_json(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, category) from the category file."""
    raw = spark.read.schema(UNIVERSE).option("multiLine", True).json(path)
    pick = lambda f, name: raw.select(F.explode(f"categories.{f}").alias("symbol"), F.lit(name).alias("category"))
    return pick("major_crypto", "major").unionByName(pick("altcoins", "altcoin"))


def sink_bars_parquet(bars: DataFrame, path: str, by: tuple[str, ...] = ("symbol", "date"), files: int = 1) -> None:
    """Snappy Parquet partitioned by `by`, replacing only the partitions present in `bars`.

    Rows are clustered on the partition columns plus `files` slices of time, so a heavy symbol is written by several tasks.
    """
    dated = bars.withColumn("date", F.to_date("ts"))
    slot = F.pmod(F.xxhash64("ts"), F.lit(files))
    laid = dated.repartition(*[F.col(c) for c in by], slot)
    drop = [c for c in ("date",) if c not in by]
    laid.drop(*drop).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*by).parquet(path)


def scan_bars_parquet(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None,
                      end: str | None = None) -> DataFrame:
    """Bars of the wanted symbols and dates; both filters prune partitions before any file is opened."""
    df = spark.read.parquet(path)
    if symbols:
        df = df.filter(F.col("symbol").cast("string").isin(symbols))
    day = F.col("date") if "date" in df.columns else F.to_date("ts")
    if start:
        df = df.filter(day >= F.lit(start).cast("date"))
    if end:
        df = df.filter(day <= F.lit(end).cast("date"))
    return df.withColumn("symbol", F.col("symbol").cast("string"))


def sink_features(features: DataFrame, path: str, stamp: str) -> None:
    """Append one snapshot partition."""
    features.withColumn("snapshot_ts", F.lit(stamp)).write.mode("append").partitionBy("snapshot_ts").parquet(path)


def scan_latest_features(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None) -> DataFrame:
    """The newest snapshot, optionally filtered; the stamp is a partition column, so older ones are not read."""
    df = spark.read.option("inferSchema", False).parquet(path)
    df = df.filter(F.col("snapshot_ts") == df.agg(F.max("snapshot_ts")).scalar())
    if symbols:
        df = df.filter(F.col("symbol").isin(symbols))
    return df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz")) if start else df


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files, megabytes and symbols of a stored table, from file metadata and the symbol column only."""
    df = spark.read.parquet(path)
    rows = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"), F.col("symbol").cast("string").alias("symbol"))
    per_file = rows.groupBy("f").agg(F.first("s").alias("s")).agg(F.count(F.lit(1)).alias("files"), (F.sum("s") / 1048576.0).alias("mb"))
    n = rows.agg(F.count_distinct("symbol"))
    return per_file.withColumn("symbols", n.scalar())


def concat_price_files(spark: SparkSession, paths: list[str], date_format: str = "dd/MM/yyyy") -> DataFrame:
    """Rows (symbol, ts, open, high, low, close) of headerless vendor files: date, open, high, low, close by position."""
    fields = T.StructType([T.StructField(c, T.StringType()) for c in ("d", "open", "high", "low", "close")])
    raw = spark.read.schema(fields).option("recursiveFileLookup", True).csv(paths)
    num = lambda c: F.expr(f"try_cast({c} AS double)").alias(c)
    return raw.select(F.regexp_extract("_metadata.file_path", NAME, 1).alias("symbol"),
                      F.try_to_timestamp(F.col("d"), F.lit(date_format)).cast("timestamp_ntz").alias("ts"),
                      *[num(c) for c in ("open", "high", "low", "close")]).dropna(subset=["ts"])


def scan_utf16_tsv(spark: SparkSession, path: str, named: str = r"symbol=([^/]+)/") -> DataFrame:
    """UTF-16 tab-separated exports: first ten characters of column one are the date, column two the price; the symbol is what `named` finds in the path."""
    raw = spark.read.option("encoding", "UTF-16").option("sep", "\t").option("multiLine", True).schema("d string, p string").csv(path)
    return raw.select(F.regexp_extract("_metadata.file_path", named, 1).alias("symbol"), F.try_to_timestamp(F.substring("d", 1, 10), F.lit("yyyy.MM.dd")).cast("timestamp_ntz").alias("ts"),
                      F.expr("try_cast(p AS double)").alias("price")).dropna(subset=["ts"])


def sink_run_stats(stats: DataFrame, path: str) -> None:
    """One-row run statistics as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def portfolio_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty typed tables for positions, trades and performance."""
    return {n: spark.createDataFrame([], s) for n, s in (("positions", POSITIONS), ("trades", TRADES), ("performance", PERFORMANCE))}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


