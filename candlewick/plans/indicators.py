"""Queries E1-E29 and the flagship: technical indicators over daily supplier bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import ln, rounded
from candlewick.functions.windows import over
from candlewick.operators import indicators as ind
from candlewick.plans.common import rowwise, whole
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, W, ctes, decay, div, flag, lag, rnd, roll, tidy
from candlewick.sources.market import supplier_bars

BASE = "SELECT symbol, ts, {} FROM bars"
KEYS = ("symbol", "ts")


def _flagship(spark, sf_dir):
    bars = supplier_bars(spark, sf_dir)
    s = over(bars)
    vol = bars.withColumn("r", ln(F.try_divide("close", s.lag("close"))))
    vol = vol.withColumns({"vol": s.std("r", 60) * 252 ** 0.5, "mean": s.mean("r", 60) * 252})
    last = vol.groupBy("symbol").agg(F.max_by(F.struct("vol", "mean", "close"), "ts").alias("x")).select("symbol", "x.*")
    ranked = last.withColumn("sharpe", F.try_divide(F.col("mean") - 0.02, F.col("vol")))
    # one row per symbol at this point; the rank and the limit see the summary, never the bars
    best = ranked.orderBy(F.desc_nulls_last("sharpe"), "symbol").limit(10)
    return rounded(best.select("symbol", "close", "vol", "sharpe"), 6, keep=("close",))


register("flagship_sharpe_leaders", _flagship, ctes(
    f"""SELECT symbol, close, {tidy('vol')} AS vol, {tidy('(m - 0.02) / nullif(vol, 0)')} AS sharpe
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM v) WHERE back = 1
    ORDER BY (m - 0.02) / nullif(vol, 0) DESC NULLS LAST, symbol LIMIT 10""",
    bars=SUPPLIER, r=f"SELECT *, ln({div('close', lag('close'))}) AS r FROM bars",
    v=f"SELECT *, {roll('stddev_samp', 'r', 60)} * sqrt(252) AS vol, {roll('avg', 'r', 60)} * 252 AS m FROM r"))

rowwise("E1_sma", ind.sma, ["sma_20", "sma_50", "sma_200"], BASE.format(
    ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200))))

EMA = {**decay("bars", "close", span=12, name="ema_12"), **decay("bars", "close", span=26, name="ema_26")}
rowwise("E2_ema", ind.ema, ["ema_12", "ema_26", "ema_50"],
        "SELECT * FROM v_ema_12 JOIN v_ema_26 USING (symbol, ts) JOIN v_ema_50 USING (symbol, ts)",
        **EMA, **decay("bars", "close", span=50, name="ema_50"))

MACD = {**EMA, "m": "SELECT symbol, ts, ema_12 - ema_26 AS macd FROM v_ema_12 JOIN v_ema_26 USING (symbol, ts)",
        **decay("m", "macd", span=9, name="macd_signal")}
rowwise("E3_macd", ind.macd, ["macd", "macd_signal", "macd_histogram"],
        "SELECT symbol, ts, macd, macd_signal, macd - macd_signal AS macd_histogram FROM m "
        "JOIN v_macd_signal USING (symbol, ts)", **MACD)

PC = lag("close")
TR = {"pc": f"SELECT *, {PC} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM bars",
      "tr": "SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range FROM pc"}
rowwise("E4_atr", ind.atr, ["true_range", "atr_14"],
        f"SELECT symbol, ts, true_range, {roll('avg', 'true_range', 14)} AS atr_14 FROM tr", **TR)

rowwise("E5_atr_ewm", ind.atr_ewm, ["price_range", "atr_ewm"],
        "SELECT symbol, ts, price_range, atr_ewm FROM pr JOIN v_atr_ewm USING (symbol, ts)",
        pr="SELECT symbol, ts, greatest(open, high, low, close) - least(open, high, low, close) AS price_range FROM bars",
        **decay("pr", "price_range", com=14, name="atr_ewm"))

ADX = {**TR,
       "dm": """SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up,
          CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn FROM tr""",
       "di": f"""SELECT *, 100 * {div(roll('avg', 'up', 14), roll('avg', 'true_range', 14))} AS plus_di,
          100 * {div(roll('avg', 'dn', 14), roll('avg', 'true_range', 14))} AS minus_di FROM dm""",
       "dxx": f"SELECT *, 100 * {div('abs(plus_di - minus_di)', 'plus_di + minus_di')} AS dx FROM di"}
rowwise("E6_adx", ind.adx, ["plus_di", "minus_di", "dx", "adx"],
        f"SELECT symbol, ts, plus_di, minus_di, dx, {roll('avg', 'dx', 14)} AS adx FROM dxx", **ADX)


def gain_loss(first: str, n: int = 14) -> dict[str, str]:
    return {"d": f"SELECT *, close - {PC} AS d FROM bars",
            "g": f"""SELECT *, CASE WHEN d IS NULL THEN {first} WHEN d > 0 THEN d ELSE 0 END AS gain,
                CASE WHEN d IS NULL THEN {first} WHEN d < 0 THEN -d ELSE 0 END AS loss FROM d""",
            "gl": f"SELECT *, {roll('avg', 'gain', n)} AS ag, {roll('avg', 'loss', n)} AS al FROM g"}


RSI = "100 - 100 / (1 + ag / nullif(al, 0))"
rowwise("E7_rsi", ind.rsi, ["rsi"], f"SELECT symbol, ts, CASE WHEN al = 0 AND ag > 0 THEN 100.0 WHEN al = 0 THEN NULL "
        f"ELSE {RSI} END AS rsi FROM gl", **gain_loss("0"))
rowwise("E8_rsi_strict", ind.rsi_strict, ["rsi_strict"], f"SELECT symbol, ts, {RSI} AS rsi_strict FROM gl",
        **gain_loss("NULL"))
rowwise("E9_rsi_eps", ind.rsi_eps, ["rsi_eps"],
        "SELECT symbol, ts, 100 - 100 / (1 + ag / (al + 1e-12)) AS rsi_eps FROM gl", **gain_loss("0"))
rowwise("E10_rsi_inf", ind.rsi_inf, ["rsi_inf"],
        f"SELECT symbol, ts, CASE WHEN al = 0 THEN 0 ELSE {RSI} END AS rsi_inf FROM gl", **gain_loss("0"))
rowwise("E11_rsi_momentum", ind.rsi_momentum, ["rsi_momentum"],
        "SELECT b.symbol, b.ts, eu / nullif(eu + ed, 0) AS rsi_momentum FROM bars b LEFT JOIN v_eu USING (symbol, ts) "
        "LEFT JOIN v_ed USING (symbol, ts)",
        d14=f"SELECT symbol, ts, close - {lag('close', 14)} AS d FROM bars",
        ud="SELECT symbol, ts, CASE WHEN d > 0 THEN d ELSE 0 END AS u, CASE WHEN d < 0 THEN -d ELSE 0 END AS dn "
           "FROM d14 WHERE d IS NOT NULL",
        **decay("ud", "u", com=14, name="eu"), **decay("ud", "dn", com=14, name="ed"))

HI14, LO14 = roll("max", "high", 14), roll("min", "low", 14)
STOCH = {"sk": f"SELECT *, 100 * {div(f'close - {LO14}', f'{HI14} - {LO14}')} AS stoch_k FROM bars"}
rowwise("E12_stochastic", ind.stochastic, ["stoch_k", "stoch_d"],
        f"SELECT symbol, ts, stoch_k, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM sk", **STOCH)
rowwise("E13_williams_r", ind.williams_r, ["williams_r"],
        BASE.format(f"-100 * {div(f'{HI14} - close', f'{HI14} - {LO14}')} AS williams_r"))
rowwise("E14_roc", lambda b: ind.volume_roc(ind.roc(b)), ["roc_10", "roc_30", "volume_roc"], BASE.format(
    f"100 * ({div('close', lag('close', 10))} - 1) AS roc_10, 100 * ({div('close', lag('close', 30))} - 1) AS roc_30, "
    f"100 * ({div('volume', lag('volume', 5))} - 1) AS volume_roc"))

BB = {"bb": f"SELECT *, {roll('avg', 'close', 20)} AS bb_middle, {roll('stddev_samp', 'close', 20)} AS sd FROM bars",
      "bx": """SELECT *, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower,
          ((bb_middle + 2 * sd) - (bb_middle - 2 * sd)) / nullif(bb_middle, 0) AS bb_width,
          (close - (bb_middle - 2 * sd)) / nullif((bb_middle + 2 * sd) - (bb_middle - 2 * sd), 0) AS bb_position FROM bb"""}
rowwise("E15_bollinger", ind.bollinger, ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position"],
        "SELECT * FROM bx", **BB)
RET = {"ret": f"SELECT *, {div('close', PC)} - 1 AS r FROM bars"}
rowwise("E16_vol_cone", ind.vol_cone, [f"vol_{n}" for n in (30, 60, 90, 180)],
        "SELECT symbol, ts, " + ", ".join(f"{roll('stddev_samp', 'r', n)} * sqrt(252) AS vol_{n}"
                                          for n in (30, 60, 90, 180)) + " FROM ret", **RET)
rowwise("E17_keltner", ind.keltner, ["keltner_upper", "keltner_lower"],
        "SELECT symbol, ts, ema_12 + 2 * a AS keltner_upper, ema_12 - 2 * a AS keltner_lower FROM "
        f"(SELECT *, {roll('avg', 'true_range', 14)} AS a FROM tr) JOIN v_ema_12 USING (symbol, ts)",
        **TR, **decay("bars", "close", span=12, name="ema_12"))
TPV = {"tp": "SELECT *, (high + low + close) / 3 * volume AS tpv FROM bars"}
rowwise("E18_vwap", ind.vwap, ["vwap_20"],
        f"SELECT symbol, ts, {div(roll('sum', 'tpv', 20), roll('sum', 'volume', 20))} AS vwap_20 FROM tp", **TPV)
rowwise("E19_vwap_cumulative", ind.vwap_cumulative, ["vwap"],
        f"SELECT symbol, ts, sum(close * volume) OVER {W} / nullif(sum(volume) OVER {W}, 0) AS vwap FROM "
        "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) WHERE back <= 20")
OBV = {"fl": f"SELECT *, CASE WHEN {PC} IS NULL THEN volume ELSE sign(close - {PC}) * volume END AS fl FROM bars"}
rowwise("E20_obv", ind.obv, ["obv"], f"SELECT symbol, ts, sum(fl) OVER {W} AS obv FROM fl", **OBV)
AD = {"af": f"SELECT *, {div('2 * close - low - high', 'high - low')} * volume AS af FROM bars"}
rowwise("E21_ad_line", ind.ad_line, ["ad_line"],
        f"SELECT symbol, ts, CASE WHEN af IS NOT NULL THEN sum(af) OVER {W} END AS ad_line FROM af", **AD)
VR = {"vr": f"SELECT *, {roll('avg', 'volume', 20)} AS volume_sma_20 FROM bars"}
rowwise("E22_volume_ratio", ind.volume_ratio, ["volume_sma_20", "volume_ratio"],
        "SELECT symbol, ts, volume_sma_20, volume / nullif(volume_sma_20, 0) AS volume_ratio FROM vr", **VR)

whole("above_sma_20", "ema_up", "macd_up", "rsi_oversold", "rsi_overbought", "stoch_oversold", "stoch_overbought",
      "bb_squeeze", "bb_breakout", "bb_breakdown", "volume_spike", "above_volume_sma")
rowwise("E23_trend_flags", lambda b: ind.trend_flags(ind.macd(ind.ema(ind.sma(b, (20,)), (12, 26)))),
        ["above_sma_20", "ema_up", "macd_up"],
        f"SELECT b.symbol, b.ts, {flag('close > s20')} AS above_sma_20, {flag('ema_12 > ema_26')} AS ema_up, "
        f"{flag('macd > macd_signal')} AS macd_up FROM (SELECT *, {roll('avg', 'close', 20)} AS s20 FROM bars) b "
        "JOIN v_ema_12 USING (symbol, ts) JOIN v_ema_26 USING (symbol, ts) JOIN m USING (symbol, ts) "
        "JOIN v_macd_signal USING (symbol, ts)", **MACD)
rowwise("E24_momentum_flags", lambda b: ind.momentum_flags(ind.stochastic(ind.rsi(b))),
        ["rsi_oversold", "rsi_overbought", "stoch_oversold", "stoch_overbought"],
        f"SELECT symbol, ts, {flag('rsi < 30')} AS rsi_oversold, {flag('rsi > 70')} AS rsi_overbought, "
        f"{flag('k < 20 AND d < 20')} AS stoch_oversold, {flag('k > 80 AND d > 80')} AS stoch_overbought FROM "
        f"(SELECT symbol, ts, CASE WHEN al = 0 AND ag > 0 THEN 100.0 WHEN al = 0 THEN NULL ELSE {RSI} END AS rsi FROM gl) "
        f"JOIN (SELECT symbol, ts, stoch_k AS k, {roll('avg', 'stoch_k', 3)} AS d FROM sk) USING (symbol, ts)",
        **gain_loss("0"), **STOCH)
rowwise("E25_volatility_flags", lambda b: ind.volatility_flags(ind.bollinger(b)),
        ["bb_squeeze", "bb_breakout", "bb_breakdown"],
        f"SELECT symbol, ts, {flag('round(bb_width, 12) < round(q, 12)')} AS bb_squeeze, "
        f"{flag('close > bb_upper')} AS bb_breakout, {flag('close < bb_lower')} AS bb_breakdown FROM "
        f"(SELECT *, {roll('quantile_cont({x}, 0.2)', 'bb_width', 20)} AS q FROM bx)", **BB)
rowwise("E26_volume_flags", lambda b: ind.volume_flags(ind.volume_ratio(b)), ["volume_spike", "above_volume_sma"],
        f"SELECT symbol, ts, {flag('volume / nullif(volume_sma_20, 0) > 2')} AS volume_spike, "
        f"{flag('volume > volume_sma_20')} AS above_volume_sma FROM vr", **VR)

# the wide feature frame as one oracle: every family joined on (symbol, ts)
FEATURES = {
    **TR, **ADX, **gain_loss("0"), **STOCH, **BB, **RET, **OBV, **VR, **MACD, **TPV, **AD,
    **decay("bars", "close", span=50, name="ema_50"),
    "fa": f"""SELECT symbol, ts, open, high, low, close, volume,
        {', '.join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200))},
        -100 * {div(f'{HI14} - close', f'{HI14} - {LO14}')} AS williams_r, 100 * ({div('close', lag('close', 10))} - 1) AS roc_10,
        100 * ({div('close', lag('close', 30))} - 1) AS roc_30, 100 * ({div('volume', lag('volume', 5))} - 1) AS volume_roc FROM bars""",
    "fb": f"SELECT symbol, ts, true_range, plus_di, minus_di, dx, {roll('avg', 'dx', 14)} AS adx, {roll('avg', 'true_range', 14)} AS atr_14 FROM dxx",
    "fc": f"SELECT symbol, ts, CASE WHEN al = 0 AND ag > 0 THEN 100.0 WHEN al = 0 THEN NULL ELSE {RSI} END AS rsi FROM gl",
    "fd": f"SELECT symbol, ts, stoch_k, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM sk",
    "fe": f"SELECT symbol, ts, bb_middle, bb_upper, bb_lower, bb_width, bb_position, {roll('quantile_cont({x}, 0.2)', 'bb_width', 20)} AS q FROM bx",
    "ff": "SELECT symbol, ts, " + ", ".join(f"{roll('stddev_samp', 'r', n)} * sqrt(252) AS vol_{n}" for n in (30, 60, 90, 180)) + " FROM ret",
    "fg": f"SELECT symbol, ts, sum(fl) OVER {W} AS obv FROM fl",
    "fh": "SELECT symbol, ts, volume_sma_20, volume / nullif(volume_sma_20, 0) AS volume_ratio FROM vr",
    "fi": f"SELECT symbol, ts, {div(roll('sum', 'tpv', 20), roll('sum', 'volume', 20))} AS vwap_20 FROM tp",
    "fj": f"SELECT symbol, ts, CASE WHEN af IS NOT NULL THEN sum(af) OVER {W} END AS ad_line FROM af",
    "wide": "SELECT *, macd - macd_signal AS macd_histogram, ema_12 + 2 * atr_14 AS keltner_upper, "
            "ema_12 - 2 * atr_14 AS keltner_lower FROM fa " + " ".join(
                f"JOIN {t} USING (symbol, ts)" for t in
                ("fb", "fc", "fd", "fe", "ff", "fg", "fh", "fi", "fj", "v_ema_12", "v_ema_26", "v_ema_50", "m", "v_macd_signal")),
}
STATES = """CASE WHEN adx > 25 THEN 'strong' ELSE 'weak' END AS trend_strength,
    CASE WHEN rsi > 70 OR stoch_k > 80 THEN 'overbought' WHEN rsi < 30 OR stoch_k < 20 THEN 'oversold' ELSE 'neutral' END AS momentum_state,
    CASE WHEN bb_width < 0.1 THEN 'low_volatility' WHEN vol_30 > 0.8 THEN 'high_volatility' ELSE 'normal_volatility' END AS volatility_state,
    CASE WHEN volume_ratio > 1.2 THEN 'increasing' ELSE 'normal' END AS volume_trend"""
SUMMARY = ("sma_20 ema_12 macd macd_signal adx rsi stoch_k williams_r bb_position bb_width atr_14 vol_30 volume_ratio obv")

register("E27_indicator_summary",
         lambda spark, d: rounded(ind.indicator_summary(ind.all_indicators(supplier_bars(spark, d), ind.SUMMARY, keep=KEYS))),
         ctes(f"SELECT symbol, ts, {rnd(SUMMARY)}, {STATES} FROM wide "
              "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1", bars=SUPPLIER, **FEATURES))


def _states(spark, d):
    f = ind.vol_cone(ind.bollinger(ind.stochastic(ind.rsi(supplier_bars(spark, d)))), (30,))
    return f.select("symbol", "ts", ind.momentum_state(F.col("rsi"), F.col("stoch_k")).alias("momentum_state"),
                    ind.volatility_state(F.col("bb_width"), F.col("vol_30")).alias("volatility_state"))


register("E28_states", _states, ctes(
    "SELECT symbol, ts, CASE WHEN rsi > 70 OR stoch_k > 80 THEN 'overbought' WHEN rsi < 30 OR stoch_k < 20 THEN "
    "'oversold' ELSE 'neutral' END AS momentum_state, CASE WHEN bb_width < 0.1 THEN 'low_volatility' WHEN vol_30 > 0.8 "
    "THEN 'high_volatility' ELSE 'normal_volatility' END AS volatility_state FROM fc JOIN fd USING (symbol, ts) "
    "JOIN fe USING (symbol, ts) JOIN ff USING (symbol, ts)", bars=SUPPLIER,
    **{k: v for k, v in FEATURES.items() if k in ("fc", "fd", "fe", "ff", "d", "g", "gl", "sk", "bb", "bx", "ret")}))

ALL = ("sma_20 sma_50 sma_200 ema_12 ema_26 ema_50 macd macd_signal macd_histogram atr_14 plus_di minus_di adx "
       "keltner_upper keltner_lower rsi stoch_k stoch_d williams_r roc_10 roc_30 volume_roc bb_middle bb_upper bb_lower "
       "bb_width bb_position vol_30 vol_60 vol_90 vol_180 vwap_20 obv ad_line volume_sma_20 volume_ratio").split()
FLAGS = ("above_sma_20 ema_up macd_up rsi_oversold rsi_overbought stoch_oversold stoch_overbought bb_squeeze "
         "bb_breakout bb_breakdown volume_spike above_volume_sma").split()
# the doubles are tidied where they are made: so many columns in one projection make a method too long for the JVM to compile
rowwise("E29_all_indicators", lambda b: ind.all_indicators(b, (*ALL, *FLAGS), 6, KEYS), ALL + FLAGS,
        f"""SELECT *, {flag('close > sma_20')} AS above_sma_20, {flag('ema_12 > ema_26')} AS ema_up,
        {flag('macd > macd_signal')} AS macd_up, {flag('rsi < 30')} AS rsi_oversold, {flag('rsi > 70')} AS rsi_overbought,
        {flag('stoch_k < 20 AND stoch_d < 20')} AS stoch_oversold, {flag('stoch_k > 80 AND stoch_d > 80')} AS stoch_overbought,
        {flag('round(bb_width, 12) < round(q, 12)')} AS bb_squeeze, {flag('close > bb_upper')} AS bb_breakout,
        {flag('close < bb_lower')} AS bb_breakdown, {flag('volume_ratio > 2')} AS volume_spike,
        {flag('volume > volume_sma_20')} AS above_volume_sma FROM wide""", tidied=True, **FEATURES)
