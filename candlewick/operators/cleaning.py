"""Alignment, gap filling, outlier treatment, normalisation and feature selection on long (symbol, ts) frames.

Per-symbol statistics are plain aggregates joined back by symbol, so a heavy symbol is combined before the shuffle and
the join side is one row per symbol: Spark broadcasts it only below its size threshold and splits skewed sides otherwise.
"""

from __future__ import annotations

import functools
import operator as op

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.guards import clean_nan, div
from candlewick.functions.windows import over

PRICES = ("open", "high", "low", "close")

# fixed values: market-cap order of the default asset universe
DEFAULT_UNIVERSE = """
BTC ETH USDT BNB USDC XRP SOL DOGE ADA STETH
TRX AVAX TON SHIB DOT WBTC LINK BCH SUI NEAR UNI LTC PEPE DAI ICP APT HEX WIF POL ARB
FET CRO ETC MNT OP IMX ATOM OKB HBAR BONK VET FIL MKR RNDR ALGO XMR OM TAO ONDO XLM
INJ FDUSD GRT KAS MANA AAVE TIA STX JUP SEI
LDO PYTH THETA AR RUNE ROSE FTM SAND AXS EGLD BLUR BEAM FLOW KCS MEME KAVA PENDLE ZRO WLD JASMY
ENS EIGEN GMX FLOKI AIOZ NOT MATIC COMP GRASS STRK QNT ORDI SAFE SNX CAKE GALA CHZ ETHFI KSM ENA
APE OSMO DEXE SYN ALPHA PIXEL CORE PRIME SUPER REZ IO MASK ALCX TRB CRV JST ARKM BICO STORJ AUDIO
CTSI BAL RLC LRC ANKR BAND SLP HOT ENJ WIN BTT CELR SKL DUSK POWR GLM REQ UMA NMR ZRX
LQTY GODS ALICE YFI CVX SUSHI BNT REN RARE OXT
""".split()


def default_universe(spark) -> DataFrame:
    return spark.createDataFrame(list(zip(DEFAULT_UNIVERSE, range(len(DEFAULT_UNIVERSE)))), "symbol string, rank int")


def combine_assets(bars: DataFrame, symbols: list[str], fields: tuple[str, ...] = ("close",)) -> DataFrame:
    """Wide view at the edge: one row per ts, one SYMBOL_field column each (outer alignment)."""
    rows = bars.filter(F.col("symbol").isin(symbols))
    return rows.groupBy("ts").agg(*[
        F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}_{f}") for s in symbols for f in fields])


def split_name(column: Column) -> tuple[Column, Column]:
    """SYMBOL and feature of a wide column name, cut at the first underscore."""
    parts = F.split(column, "_", 2)
    return parts[0], parts[1]


def wide_to_long(wide: DataFrame, fields: tuple[str, ...], min_rows: int = 10) -> DataFrame:
    """Long form of SYMBOL_field columns; assets with at most `min_rows` complete rows are left out."""
    names = [c for c in wide.columns if "_" in c]
    symbol, field = split_name(F.col("name"))
    tall = wide.unpivot(["ts"], names, "name", "value").select("ts", symbol.alias("symbol"), field.alias("field"), "value")
    rows = tall.groupBy("symbol", "ts").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    whole = rows.dropna(subset=list(fields))
    enough = whole.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows)
    return whole.join(enough.select("symbol"), "symbol", "left_semi")


def stack(df: DataFrame, keys: list[str], stats: dict[str, dict[str, str]], name: str = "column") -> DataFrame:
    """Turn a one-row-per-key wide summary into one row per (key, name)."""
    rows = F.array(*[F.struct(F.lit(n).alias(name), *[F.col(c).alias(o) for o, c in cols.items()])
                     for n, cols in stats.items()])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def column_profile(df: DataFrame, columns: tuple[str, ...], max_missing: float = 0.1, min_rows: int = 30) -> DataFrame:
    """Count, missing, ratio, min, max, std and type per (symbol, column); one aggregate, unpivoted afterwards."""
    kinds = dict(df.dtypes)
    aggs, stats = [F.count(F.lit(1)).alias("_rows")], {}
    for c in columns:
        aggs += [F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                 F.stddev_samp(c).alias(f"{c}_std")]
        stats[c] = {"rows": "_rows", "present": f"{c}_n", "min": f"{c}_min", "max": f"{c}_max", "std": f"{c}_std"}
    tall = stack(df.groupBy("symbol").agg(*aggs), ["symbol"], stats)
    missing = F.col("rows") - F.col("present")
    kind = functools.reduce(lambda a, c: F.when(F.col("column") == c, kinds[c]).otherwise(a), columns, F.lit("double"))
    return tall.withColumns({"missing": missing, "missing_ratio": missing / F.col("rows"), "dtype": kind}).withColumn(
        "flagged", (F.col("missing_ratio") > max_missing) | (F.col("present") < min_rows))


def filter_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of ranked assets with their tier; when no asset is ranked, all bars are kept."""
    listed = bars.select("symbol").distinct()
    any_hit = universe.join(listed, "symbol", "left_semi").agg((F.count(F.lit(1)) > 0).alias("hit"))
    ranked = bars.join(universe.select("symbol", "rank"), "symbol", "left")
    return ranked.filter(F.col("rank").isNotNull() | ~any_hit.scalar()).withColumn("asset_tier", asset_tier(F.col("rank")))


def asset_tier(rank: Column) -> Column:
    """Tier name from the zero-based rank."""
    return (F.when(rank.isNull(), "not_tracked").when(rank < 10, "tier1_major").when(rank < 30, "tier2_large")
            .when(rank < 60, "tier3_mid_large").when(rank < 100, "tier4_mid").otherwise("tier5_smaller"))


def resample(bars: DataFrame, unit: str = "day") -> DataFrame:
    """Calendar bins per symbol; a bin without bars has volume 0 and NULL prices."""
    binned = bars.withColumn("bin", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    got = binned.groupBy("symbol", "bin").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("quote_volume").alias("quote_volume"))
    # each bin unfolds to itself and the empty ones before the next, so the bars are read once and their symbols stay together
    step = F.expr(f"interval 1 {unit}")
    kept = got.filter(F.col("bin").isNotNull())
    until = F.coalesce(F.lead("bin").over(over(kept, order=("bin",)).w) - step, F.col("bin"))
    grid = kept.withColumn("_until", until).withColumn("ts", F.explode(F.sequence("bin", "_until", step)))
    own = (F.col("ts") == F.col("bin")) & F.col("symbol").isNotNull()
    zero = {"volume": 0.0, "quote_volume": 0.0}
    return grid.select("symbol", "ts", *[F.when(own, F.col(c)).alias(c) for c in (*PRICES, "volume", "quote_volume")]).fillna(zero)


def panel(bars: DataFrame, unit: str = "week", limit: int | None = None) -> DataFrame:
    """Aligned calendar bars: prices carried over empty bins, at most `limit` of them if given, rows without a price left out."""
    return ffill(resample(bars, unit), PRICES, limit).dropna(subset=["close"])


def ffill(df: DataFrame, columns: tuple[str, ...], limit: int | None = 3) -> DataFrame:
    """Carry the last value over at most `limit` NULL rows, over all if it is None."""
    w = over(df).w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def interpolate_linear(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Straight line between neighbours by row position; the tail holds the last value, the head stays NULL."""
    s = over(df)
    # the next value is the last one in reverse order: a running frame, where a following frame would be quadratic
    ahead = s.desc.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_i", s.position())
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        out = out.withColumns({"_p": F.last(at, ignorenulls=True).over(s.running),
                               "_q": F.last(at, ignorenulls=True).over(ahead)})
        line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * div(F.col("_i") - F.col("_p.i"), F.col("_q.i") - F.col("_p.i"))
        out = out.withColumn(c, F.coalesce(F.col(c), line, F.col("_p.v"))).drop("_p", "_q")
    return out.drop("_i")


def drop_sparse(df: DataFrame, column: str = "close", max_missing: float = 0.1) -> DataFrame:
    """Remove the symbols whose share of NULLs exceeds the limit."""
    sparse = df.groupBy("symbol").agg((F.count_if(F.col(column).isNull()) / F.count(F.lit(1))).alias("m")).filter(
        F.col("m") > max_missing)
    return df.join(sparse.select("symbol"), "symbol", "left_anti")


def _with_stats(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.join(df.groupBy("symbol").agg(*aggs), "symbol")


def _quantiles(columns: tuple[str, ...], *qs: float) -> list[Column]:
    return [F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(f"_q_{c}") for c in columns]


def winsorize(df: DataFrame, columns: tuple[str, ...], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip each column to its own quantiles per symbol."""
    out = _with_stats(df, *_quantiles(columns, low, high))
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q_{c}")[1]), F.col(f"_q_{c}")[0]))
               for c in columns}
    return out.withColumns(clipped).drop(*[f"_q_{c}" for c in columns])


def null_zscore_outliers(df: DataFrame, columns: tuple[str, ...], limit: float = 3.0) -> DataFrame:
    out = _with_stats(df, *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    kept = {c: F.when(~F.coalesce(F.abs(div(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}")) > limit, F.lit(False)), F.col(c))
            for c in columns}
    return out.withColumns(kept).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def null_iqr_outliers(df: DataFrame, columns: tuple[str, ...], k: float = 1.5) -> DataFrame:
    out = _with_stats(df, *_quantiles(columns, 0.25, 0.75))
    kept = {}
    for c in columns:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        kept[c] = F.when((F.col(c) >= q1 - k * (q3 - q1)) & (F.col(c) <= q3 + k * (q3 - q1)), F.col(c))
    return out.withColumns(kept).drop(*[f"_q_{c}" for c in columns])


def outlier_counts(before: DataFrame, after: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Values nulled per symbol and column, with the symbol's total."""
    a, b = (d.groupBy("symbol").agg(*[F.count(c).alias(f"{p}_{c}") for c in columns]) for p, d in (("a", before), ("b", after)))
    gone = a.join(b, "symbol").select("symbol", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c}_removed") for c in columns])
    return gone.withColumn("total_removed", functools.reduce(op.add, [F.col(f"{c}_removed") for c in columns]))


def asset_returns(bars: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """Simple return, annualised rolling volatility, and annual mean over that volatility."""
    s = over(bars)
    out = bars.withColumn("returns", s.change("close"))
    out = out.withColumn(f"volatility_{short}d", s.std("returns", short) * 252 ** 0.5)
    return out.withColumn(f"sharpe_{long}d", div(s.mean("returns", long) * 252, f"volatility_{short}d"))


def normalize(df: DataFrame, columns: tuple[str, ...], method: str = "standardize") -> DataFrame:
    """Per-symbol z-score, min-max, or median / (1.4826 * median absolute deviation) scaling."""
    if method == "none":
        return df
    if method == "standardize":
        out = _with_stats(df, *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.avg), ("b", F.stddev_samp))])
        return out.withColumns({c: div(F.col(c) - F.col(f"_a_{c}"), f"_b_{c}") for c in columns}).drop(
            *[f"_{n}_{c}" for c in columns for n in "ab"])
    if method == "minmax":
        out = _with_stats(df, *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
        return out.withColumns({c: div(F.col(c) - F.col(f"_a_{c}"), F.col(f"_b_{c}") - F.col(f"_a_{c}")) for c in columns}).drop(
            *[f"_{n}_{c}" for c in columns for n in "ab"])
    if method == "robust":
        mid = _with_stats(df, *[F.percentile(c, F.lit(0.5)).alias(f"_a_{c}") for c in columns])
        out = _with_stats(mid, *[F.percentile(F.abs(F.col(c) - F.col(f"_a_{c}")), F.lit(0.5)).alias(f"_b_{c}") for c in columns])
        return out.withColumns({c: div(F.col(c) - F.col(f"_a_{c}"), 1.4826 * F.col(f"_b_{c}")) for c in columns}).drop(
            *[f"_{n}_{c}" for c in columns for n in "ab"])
    raise ValueError(f"unknown method {method}")


def normalize_by_role(df: DataFrame, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    """Roles map to methods: prices stay, volumes are scaled robustly, returns are standardised."""
    out = normalize(df, roles["volume"], "robust") if roles.get("volume") else df
    return normalize(out, roles["returns"], "standardize") if roles.get("returns") else out


def vol_regime(bars: DataFrame, n: int = 30, rank_window: int = 252, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """2 / 0 when the rolling deviation ranks above / below the bounds in its own window, else 1."""
    s = over(bars)
    out = bars.withColumn("_r", s.change("close")).withColumn("_vol", s.std("_r", n))
    out = out.withColumn("_seen", s.full(F.collect_list, "_vol", rank_window))
    below = F.size(F.filter("_seen", lambda x: x < F.col("_vol")))
    same = F.size(F.filter("_seen", lambda x: x == F.col("_vol")))
    out = out.withColumn("vol_rank", F.when(F.col("_seen").isNotNull(), (below + (same + 1) / 2) / rank_window))
    return out.withColumn("vol_regime", F.when(F.col("vol_rank") > high, 2).when(F.col("vol_rank") < low, 0).otherwise(1)).drop(
        "_r", "_vol", "_seen")


def trend_regime(bars: DataFrame, short: int = 20, long: int = 50, band: float = 0.02) -> DataFrame:
    s = over(bars)
    a, b = s.mean("close", short), s.mean("close", long)
    return bars.withColumn("trend_regime", F.when(a > b * (1 + band), 1).when(a < b * (1 - band), -1).otherwise(0))


def final_quality(df: DataFrame, columns: tuple[str, ...], extreme: float = 1000.0) -> DataFrame:
    """One row: shape, missing, infinite and extreme cells, date range."""
    total = lambda cond: functools.reduce(op.add, [F.count_if(F.coalesce(cond(F.col(c)), F.lit(False))) for c in columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(columns)).cast("long").alias("columns"),
        total(lambda c: c.isNull() | F.isnan(c)).alias("missing"),
        total(lambda c: F.abs(c) == float("inf")).alias("infinite"),
        total(lambda c: F.abs(c) > extreme).alias("extreme"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def feature_stats(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Null share and variance per (symbol, feature); one wide aggregate, no row blow-up."""
    aggs = [x for f in features for x in ((F.count_if(F.col(f).isNull()) / F.count(F.lit(1))).alias(f"{f}_nulls"),
                                          F.var_samp(f).alias(f"{f}_var"))]
    return stack(df.groupBy("symbol").agg(*aggs), ["symbol"],
                 {f: {"null_share": f"{f}_nulls", "variance": f"{f}_var"} for f in features}, "feature")


def select_features(stats: DataFrame, max_nulls: float = 0.8) -> DataFrame:
    """Features with enough values and some variance."""
    return stats.filter((F.col("null_share") < max_nulls) & (F.col("variance") > 0))


def top_variance_features(stats: DataFrame, n: int = 100) -> DataFrame:
    """The n most varying features of each symbol; a symbol's group is its feature list, never its bars."""
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("variance"), "feature")
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def keep_features(df: DataFrame, selected: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Blank the features not selected for a symbol."""
    lists = selected.groupBy("symbol").agg(F.collect_set("feature").alias("_keep"))
    out = df.join(lists, "symbol", "left")
    return out.withColumns({f: F.when(F.array_contains("_keep", f), F.col(f)) for f in features}).drop("_keep")


def prepare_features(frames: list[DataFrame], limit: int = 3) -> DataFrame:
    """Join feature families on (symbol, ts); the first frame wins on a repeated name; fill at most `limit` rows."""
    keys = ["symbol", "ts"]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.drop(*[c for c in f.columns if c in out.columns and c not in keys]), keys, "full")
    values = [c for c, k in out.dtypes if k == "double"]
    finite = {c: F.when(F.abs(clean_nan(c)) != float("inf"), F.col(c)) for c in values}
    return ffill(out.withColumns(finite), tuple(values), limit).dropna("all", subset=values)


def feature_quality(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    nulls = functools.reduce(op.add, [F.count_if(F.col(f).isNull()) for f in features])
    return df.agg(F.lit(len(features)).cast("long").alias("features"), F.count(F.lit(1)).alias("observations"),
                  (nulls / (F.count(F.lit(1)) * len(features))).alias("missing_ratio"),
                  F.min("ts").alias("start"), F.max("ts").alias("end"))


def preview_scores(df: DataFrame, momentum: str, n: int = 30) -> DataFrame:
    """Mean of the newest n values of a momentum feature per symbol, 0 when there is none."""
    tail = df.withColumn("_back", over(df).from_last()).filter(F.col("_back") <= n)
    return tail.groupBy("symbol").agg(F.coalesce(F.avg(momentum), F.lit(0.0)).alias("preview_score"))
