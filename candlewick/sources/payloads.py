"""Vendor payloads and metadata records turned into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.schemas import require_columns

CANDLE = "struct<" + ", ".join(f"{k}: array<string>" for k in "tohlcv") + ">"
PAIRS = "struct<prices: array<array<double>>, total_volumes: array<array<double>>>"


def parse_candle_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Object of parallel arrays t, o, h, l, c, v to bars; a missing key or unequal lengths drop the payload, a bad value
    drops its row."""
    j = F.from_json(payload, CANDLE)
    raw = df.select("symbol", j.alias("j"))
    same = F.lit(True)
    for k in "ohlcv":
        same = same & (F.size("j.t") == F.size(f"j.{k}"))
    whole = raw.filter(F.col("j.t").isNotNull() & F.coalesce(same, F.lit(False)))
    rows = whole.select("symbol", F.explode(F.arrays_zip(*[F.col(f"j.{k}").alias(k) for k in "tohlcv"])).alias("r"))
    num = lambda k: F.expr(f"try_cast(r.{k} AS double)")
    out = rows.select("symbol", F.timestamp_seconds(F.expr("try_cast(r.t AS bigint)")).cast("timestamp_ntz").alias("ts"), num("o").alias("open"),
                      num("h").alias("high"), num("l").alias("low"), num("c").alias("close"), num("v").alias("volume")).dropna()
    return out.withColumn("quote_volume", F.col("volume") * F.col("close"))


def parse_price_pairs_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """[ms, price] pairs to flat bars; volume is taken by position, 0 when absent."""
    j = df.select("symbol", F.from_json(payload, PAIRS).alias("j"))
    rows = j.select("symbol", F.posexplode("j.prices").alias("i", "p"), F.col("j.total_volumes").alias("v"))
    price = F.col("p")[1]
    volume = F.coalesce(F.get(F.get("v", F.col("i")), F.lit(1)), F.lit(0.0))
    return rows.select("symbol", F.timestamp_millis(F.col("p")[0].cast("bigint")).cast("timestamp_ntz").alias("ts"),
                       *[price.alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"), (volume * price).alias("quote_volume"))


def normalize_vendor_bars(df: DataFrame) -> DataFrame:
    """Capitalised vendor columns to the bar layout."""
    require_columns(df, ["Open", "High", "Low", "Close", "Volume"])
    return df.select("symbol", "ts", *[F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")],
                     (F.col("Volume") * F.col("Close")).alias("quote_volume"))


def filter_quote_pairs(df: DataFrame, column: str = "pair", suffix: str = "-BRL") -> DataFrame:
    """Keep pairs quoted in the wanted currency, named by their base symbol."""
    return df.filter(F.col(column).endswith(suffix)).withColumn("symbol", F.regexp_replace(column, f"{suffix}$", ""))


def symbol_id_map(df: DataFrame, order: str) -> DataFrame:
    """Upper-case symbol to id; the last listed id wins, empty entries are dropped. Kept as an aggregate, not a sort."""
    rows = df.filter((F.coalesce("symbol", F.lit("")) != "") & (F.coalesce("id", F.lit("")) != ""))
    return rows.groupBy(F.upper("symbol").alias("symbol")).agg(F.max_by("id", order).alias("id"))


def first_available_source(bars: DataFrame) -> DataFrame:
    """Of several vendors keep, per symbol, the rows of the one with the lowest `priority`."""
    best = bars.groupBy("symbol").agg(F.min("priority").alias("priority"))
    return bars.join(best, ["symbol", "priority"], "left_semi")


def merge_metadata(universe: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Prefer B when it has a market cap (volume and activity from A), else A, else a minimal row."""
    x = a.select("symbol", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "symbol"])
    y = b.select("symbol", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "symbol"])
    both = universe.select("symbol").join(x, "symbol", "left").join(y, "symbol", "left")
    from_b = F.col("b_market_cap_usd").isNotNull()
    has_a = F.col("a_name").isNotNull()
    return both.select(
        "symbol", F.when(from_b, F.col("b_name")).when(has_a, F.col("a_name")).otherwise(F.col("symbol")).alias("name"),
        F.when(from_b, F.col("b_market_cap_usd")).otherwise(F.col("a_market_cap_usd")).alias("market_cap_usd"),
        F.col("a_daily_volume_brl").alias("daily_volume_brl"), F.coalesce("a_is_active", F.lit(True)).alias("is_active"),
        F.when(from_b, "b").when(has_a, "a").otherwise("minimal").alias("source"))


def complete_dataset_filter(bars: DataFrame, assets: DataFrame, days: int) -> DataFrame:
    """Bars of active assets with at least max(30, days // 3) bars."""
    need = max(30, days // 3)
    enough = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need)
    good = enough.join(assets.filter("is_active"), "symbol", "left_semi").select("symbol")
    return bars.join(good, "symbol", "left_semi")


def record_hash(df: DataFrame) -> DataFrame:
    """md5 of the row as JSON with sorted field names."""
    cols = sorted(c for c in df.columns if c not in ("data_hash", "last_updated"))
    return df.withColumn("data_hash", F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})))


def upsert_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per symbol, the newest by `last_updated`; `changed` marks rows whose content is new."""
    rows = record_hash(old.drop("data_hash")).withColumn("_batch", F.lit(0)).unionByName(
        record_hash(new.drop("data_hash")).withColumn("_batch", F.lit(1)))
    w = Window.partitionBy("symbol").orderBy(F.desc("_batch"), F.desc("last_updated"))
    kept = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k", "_batch")
    seen = record_hash(old.drop("data_hash")).select("symbol", "data_hash", F.lit(True).alias("_seen"))
    return kept.join(seen, ["symbol", "data_hash"], "left").withColumn("changed", F.col("_seen").isNull()).drop("_seen")


def scan_assets(assets: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    return assets if symbols is None else assets.join(symbols.select("symbol"), "symbol", "left_semi")


def asset_stats(assets: DataFrame) -> DataFrame:
    return assets.agg(F.count(F.lit(1)).alias("assets"), F.count_if("is_active").alias("active"),
                      F.count_distinct("exchange").alias("exchanges"), F.count_distinct("sector").alias("sectors"),
                      F.avg("market_cap_usd").alias("avg_market_cap"))
