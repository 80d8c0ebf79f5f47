"""Queries D1-D12, D15-D16, D18-D25: cleaning and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import cleaning as cl
from candlewick.operators import indicators as ind
from candlewick.plans.common import rowwise, whole
from candlewick.plans.registry import register
from candlewick.plans.sqltext import ASSETS, DIRTY, GAPPY, SEGMENT, SUPPLIER, W, ctes, div, lag, rnd, roll, tidy
from candlewick.sources.market import assets, dirty_bars, gappy_bars, segment_bars, supplier_bars

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
WIDE = "SELECT ts, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN {f} END) AS {s}_{f}" for s in SEGMENTS
                                 for f in ("close", "volume")) + " FROM bars GROUP BY ts"
register("D1_combine_assets", lambda spark, d: cl.combine_assets(segment_bars(spark, d), SEGMENTS, ("close", "volume")),
         ctes(WIDE, bars=SEGMENT))

COLS = ("open", "high", "low", "close", "volume", "quote_volume")
register("D2_column_profile", lambda spark, d: rounded(cl.column_profile(gappy_bars(spark, d), COLS), 4), ctes(
    " UNION ALL ".join(
        f"""SELECT symbol, '{c}' AS "column", count(*) AS rows, count({c}) AS present, {tidy(f'min({c})', 4)} AS min,
        {tidy(f'max({c})', 4)} AS max, {tidy(f'stddev_samp({c})', 4)} AS std, count(*) - count({c}) AS missing,
        {tidy(f'1 - count({c}) / CAST(count(*) AS DOUBLE)', 4)} AS missing_ratio, 'double' AS dtype,
        (1 - count({c}) / CAST(count(*) AS DOUBLE)) > 0.1 OR count({c}) < 30 AS flagged FROM bars GROUP BY symbol"""
        for c in COLS), bars=GAPPY))


def universe_of(spark, d, n=150):
    """The n largest assets by market cap, ranked from 0; the rank sees n rows only."""
    top = assets(spark, d).select("symbol", "market_cap_usd").orderBy(F.desc("market_cap_usd"), "symbol").limit(n)
    return top.agg(F.sort_array(F.collect_list(F.struct((-F.col("market_cap_usd")).alias("m"), "symbol"))).alias("l")).select(
        F.posexplode("l").alias("rank", "a")).select("a.symbol", "rank")


register("D3_filter_universe", lambda spark, d: cl.filter_universe(
    supplier_bars(spark, d), universe_of(spark, d)).select("symbol", "ts", "close", "rank", "asset_tier"),
    ctes("""SELECT symbol, ts, close, rank, CASE WHEN rank < 10 THEN 'tier1_major' WHEN rank < 30 THEN 'tier2_large'
      WHEN rank < 60 THEN 'tier3_mid_large' WHEN rank < 100 THEN 'tier4_mid' ELSE 'tier5_smaller' END AS asset_tier
      FROM bars JOIN u USING (symbol)""", bars=SUPPLIER, assets=ASSETS,
         u="SELECT symbol, row_number() OVER (ORDER BY market_cap_usd DESC, symbol) - 1 AS rank FROM assets "
           "ORDER BY market_cap_usd DESC, symbol LIMIT 150"))

register("D4_resample", lambda spark, d: rounded(cl.resample(supplier_bars(spark, d), "week"), 2, keep=cl.PRICES), ctes(
    """SELECT g.symbol, g.ts, open, high, low, close, round(coalesce(volume, 0), 2) AS volume,
    round(coalesce(quote_volume, 0) + 1e-5, 2) AS quote_volume FROM grid g LEFT JOIN wk w USING (symbol, ts)""",
    bars=SUPPLIER, wk="""SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, b.ts) AS close, sum(volume) AS volume, sum(quote_volume) AS quote_volume FROM bars b GROUP BY symbol, date_trunc('week', b.ts)""",
    grid="SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS ts FROM wk GROUP BY symbol"))

rowwise("D5_ffill", lambda b: cl.ffill(b, ("close",)), ["close"],
        "SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING "
        "AND CURRENT ROW) AS close FROM bars", source=gappy_bars, bars=GAPPY)
rowwise("D6_interpolate_linear", lambda b: cl.interpolate_linear(b, ("close",)), ["close"],
        """SELECT symbol, ts, coalesce(close, pv + (qv - pv) * (i - pi) / nullif(qi - pi, 0), pv) AS close FROM (
        SELECT *, last_value(close IGNORE NULLS) OVER a AS pv, first_value(close IGNORE NULLS) OVER b AS qv,
        last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
        first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER b AS qi FROM num
        WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        source=gappy_bars, bars=GAPPY, num=f"SELECT *, CAST(row_number() OVER {W} AS DOUBLE) AS i FROM bars")
register("D7_drop_sparse", lambda spark, d: cl.drop_sparse(dirty_bars(spark, d), "close", 0.0345).select(
    "symbol", "ts", "close", "volume"),
    ctes("""SELECT symbol, ts, close, volume FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars GROUP BY symbol
    HAVING count_if(close IS NULL) / CAST(count(*) AS DOUBLE) > 0.0345)""", bars=DIRTY))

ST = {"bars": DIRTY, "st": """SELECT symbol, quantile_cont(close, 0.01) AS q01, quantile_cont(close, 0.99) AS q99,
    quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3, avg(close) AS m, stddev_samp(close) AS s,
    quantile_cont(volume, 0.01) AS v01, quantile_cont(volume, 0.99) AS v99 FROM bars GROUP BY symbol"""}
register("D8_winsorize", lambda spark, d: rounded(cl.winsorize(dirty_bars(spark, d), ("close", "volume")).select(
    "symbol", "ts", "close", "volume")), ctes(
    f"SELECT symbol, ts, {tidy('CASE WHEN close IS NOT NULL THEN greatest(least(close, q99), q01) END')} AS close, "
    f"{tidy('greatest(least(volume, v99), v01)')} AS volume FROM bars JOIN st USING (symbol)", **ST))
register("D9_null_zscore_outliers", lambda spark, d: cl.null_zscore_outliers(dirty_bars(spark, d), ("close",)).select(
    "symbol", "ts", "close"), ctes(
    "SELECT symbol, ts, CASE WHEN coalesce(abs((close - m) / nullif(s, 0)) > 3, false) THEN NULL ELSE close END AS close "
    "FROM bars JOIN st USING (symbol)", **ST))
register("D10_null_iqr_outliers", lambda spark, d: cl.null_iqr_outliers(dirty_bars(spark, d), ("close",)).select(
    "symbol", "ts", "close"), ctes(
    "SELECT symbol, ts, CASE WHEN close >= q1 - 1.5 * (q3 - q1) AND close <= q3 + 1.5 * (q3 - q1) THEN close END AS close "
    "FROM bars JOIN st USING (symbol)", **ST))


def _counts(spark, d):
    b = dirty_bars(spark, d)
    return cl.outlier_counts(b, cl.null_iqr_outliers(b, ("close", "volume")), ("close", "volume"))


register("D11_outlier_counts", _counts, ctes(
    """SELECT symbol, count_if(close < cl OR close > ch) AS close_removed, count_if(volume < vl OR volume > vh) AS volume_removed,
    count_if(close < cl OR close > ch) + count_if(volume < vl OR volume > vh) AS total_removed FROM bars JOIN f USING (symbol) GROUP BY symbol""",
    bars=DIRTY, f="""SELECT symbol, a - 1.5 * (b - a) AS cl, b + 1.5 * (b - a) AS ch, c - 1.5 * (e - c) AS vl, e + 1.5 * (e - c) AS vh FROM (
    SELECT symbol, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS b, quantile_cont(volume, 0.25) AS c,
    quantile_cont(volume, 0.75) AS e FROM bars GROUP BY symbol)"""))

RETS = {"rr": f"SELECT *, {div('close', lag('close'))} - 1 AS returns FROM bars"}
rowwise("D12_asset_returns", cl.asset_returns, ["returns", "volatility_20d", "sharpe_60d"],
        f"SELECT symbol, ts, returns, {roll('stddev_samp', 'returns', 20)} * sqrt(252) AS volatility_20d, "
        f"{roll('avg', 'returns', 60)} * 252 / nullif({roll('stddev_samp', 'returns', 20)} * sqrt(252), 0) AS sharpe_60d FROM rr",
        **RETS)

NS = {"ns": """SELECT symbol, avg(close) AS m, stddev_samp(close) AS s, min(close) AS lo, max(close) AS hi, median(close) AS med,
      median(volume) AS vmed, avg(returns) AS rm, stddev_samp(returns) AS rs FROM rr GROUP BY symbol""",
      "md": """SELECT symbol, median(abs(close - med)) AS mad, median(abs(volume - vmed)) AS vmad FROM rr JOIN ns USING (symbol) GROUP BY symbol"""}


def _normalize(spark, d):
    b = supplier_bars(spark, d).select("symbol", "ts", "close", F.col("close").alias("z"), F.col("close").alias("mm"),
                                       F.col("close").alias("rb"))
    out = cl.normalize(cl.normalize(cl.normalize(b, ("z",)), ("mm",), "minmax"), ("rb",), "robust")
    return rounded(cl.normalize(out, ("close",), "none"), keep=("close",))


register("D15_normalize", _normalize, ctes(
    f"SELECT symbol, ts, close, {tidy('(close - m) / nullif(s, 0)')} AS z, {tidy('(close - lo) / nullif(hi - lo, 0)')} AS mm, "
    f"{tidy('(close - med) / nullif(1.4826 * mad, 0)')} AS rb FROM rr JOIN ns USING (symbol) JOIN md USING (symbol)",
    bars=SUPPLIER, **RETS, **NS))
register("D16_normalize_by_role", lambda spark, d: rounded(cl.normalize_by_role(
    cl.asset_returns(supplier_bars(spark, d)), {"price": ("close",), "volume": ("volume",), "returns": ("returns",)}).select(
    "symbol", "ts", "close", "volume", "returns"), keep=("close",)), ctes(
    f"SELECT symbol, ts, close, {tidy('(volume - vmed) / nullif(1.4826 * vmad, 0)')} AS volume, "
    f"{tidy('(returns - rm) / nullif(rs, 0)')} AS returns FROM rr JOIN ns USING (symbol) JOIN md USING (symbol)",
    bars=SUPPLIER, **RETS, **NS))

whole("vol_regime", "trend_regime")
rowwise("D18_vol_regime", cl.vol_regime, ["vol_rank", "vol_regime"],
        """SELECT symbol, ts, vol_rank, CASE WHEN vol_rank > 0.8 THEN 2 WHEN vol_rank < 0.2 THEN 0 ELSE 1 END AS vol_regime FROM (
        SELECT symbol, ts, CASE WHEN len(seen) = 252 THEN (len(list_filter(seen, lambda x: x < v)) + (len(list_filter(seen, lambda x: x = v)) + 1) / 2.0) / 252 END AS vol_rank
        FROM (SELECT symbol, ts, v, list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS seen FROM vv))""",
        **RETS, vv=f"SELECT symbol, ts, {roll('stddev_samp', 'returns', 30)} AS v FROM rr")
rowwise("D19_trend_regime", cl.trend_regime, ["trend_regime"],
        "SELECT symbol, ts, CASE WHEN a > b * 1.02 THEN 1 WHEN a < b * 0.98 THEN -1 ELSE 0 END AS trend_regime FROM "
        f"(SELECT symbol, ts, {roll('avg', 'close', 20)} AS a, {roll('avg', 'close', 50)} AS b FROM bars)")

FEATS = ("close", "volume", "returns", "volatility_20d", "sharpe_60d")
AR = {**RETS, "ar": f"""SELECT symbol, ts, close, volume, returns, {roll('stddev_samp', 'returns', 20)} * sqrt(252) AS volatility_20d,
    {roll('avg', 'returns', 60)} * 252 / nullif({roll('stddev_samp', 'returns', 20)} * sqrt(252), 0) AS sharpe_60d FROM rr"""}
register("D20_final_quality", lambda spark, d: cl.final_quality(cl.asset_returns(supplier_bars(spark, d)), FEATS), ctes(
    "SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, " + " + ".join(f"count_if({c} IS NULL)" for c in FEATS) + " AS missing, "
    "CAST(0 AS BIGINT) AS infinite, " + " + ".join(f"count_if(abs({c}) > 1000)" for c in FEATS) + " AS extreme, "
    'min(ts) AS start, max(ts) AS "end" FROM ar', bars=SUPPLIER, **AR))
register("D21_wide_to_long", lambda spark, d: cl.wide_to_long(
    cl.combine_assets(segment_bars(spark, d), SEGMENTS, ("close", "volume")), ("close", "volume")), ctes(
    "SELECT symbol, ts, close, volume FROM bars WHERE close IS NOT NULL AND volume IS NOT NULL AND symbol IN "
    "(SELECT symbol FROM bars GROUP BY symbol HAVING count(*) > 10)", bars=SEGMENT))

FS = {"fs": " UNION ALL ".join(f"SELECT symbol, '{c}' AS feature, count_if({c} IS NULL) / CAST(count(*) AS DOUBLE) AS null_share, "
                               f"var_samp({c}) AS variance FROM ar GROUP BY symbol" for c in FEATS)}


def _stats(spark, d):
    return cl.feature_stats(cl.asset_returns(supplier_bars(spark, d)), FEATS)


register("D22_select_features", lambda spark, d: rounded(cl.select_features(_stats(spark, d), 0.1), 4), ctes(
    f"SELECT symbol, feature, {rnd('null_share variance', 4)} FROM fs WHERE null_share < 0.1 AND variance > 0",
    bars=SUPPLIER, **AR, **FS))
register("D23_top_variance_features", lambda spark, d: rounded(cl.top_variance_features(_stats(spark, d), 3), 4), ctes(
    f"SELECT symbol, feature, {rnd('null_share variance', 4)}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol "
    "ORDER BY variance DESC NULLS LAST, feature) AS INTEGER) AS rank FROM fs) WHERE rank <= 3", bars=SUPPLIER, **AR, **FS))


def _prepare(spark, d):
    b = supplier_bars(spark, d)
    a = cl.asset_returns(b).select("symbol", "ts", "returns", "volatility_20d", "sharpe_60d")
    c = ind.roc(ind.bollinger(b), (10,)).select("symbol", "ts", "bb_width", "roc_10")
    return cl.prepare_features([a, c])


FILL = lambda c: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
PREP = {**AR, "bbw": f"""SELECT symbol, ts, 4 * {roll('stddev_samp', 'close', 20)} / nullif({roll('avg', 'close', 20)}, 0) AS bb_width,
        100 * ({div('close', lag('close', 10))} - 1) AS roc_10 FROM bars""",
        "prep": "SELECT symbol, ts, " + ", ".join(f"{FILL(c)} AS {c}" for c in ("returns", "volatility_20d", "sharpe_60d", "bb_width", "roc_10"))
                + " FROM ar JOIN bbw USING (symbol, ts)"}
PF = "returns volatility_20d sharpe_60d bb_width roc_10"
register("D24_prepare_features", lambda spark, d: rounded(_prepare(spark, d)), ctes(
    f"SELECT symbol, ts, {rnd(PF)} FROM prep WHERE coalesce({', '.join(PF.split())}) IS NOT NULL", bars=SUPPLIER, **PREP))


def _quality(spark, d):
    f = cl.feature_quality(cl.asset_returns(supplier_bars(spark, d)), FEATS)
    return rounded(f)


register("D25_feature_quality", _quality, ctes(
    "SELECT CAST(5 AS BIGINT) AS features, count(*) AS observations, " + tidy(
        "(" + " + ".join(f"count_if({c} IS NULL)" for c in FEATS) + ") / (count(*) * 5.0)") +
    ' AS missing_ratio, min(ts) AS start, max(ts) AS "end" FROM ar', bars=SUPPLIER, **AR))
register("D25_preview_scores", lambda spark, d: rounded(cl.preview_scores(ind.roc(supplier_bars(spark, d)), "roc_10")), ctes(
    f"SELECT symbol, {tidy('coalesce(avg(roc_10), 0)')} AS preview_score FROM (SELECT *, row_number() OVER (PARTITION BY symbol "
    "ORDER BY ts DESC) AS back FROM bbw) WHERE back <= 30 GROUP BY symbol", bars=SUPPLIER, bbw=PREP["bbw"]))
