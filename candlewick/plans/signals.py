"""Queries J1-J9: predictive signals over daily supplier bars, seen on the 15th."""

from __future__ import annotations

from candlewick.functions.guards import rounded
from candlewick.operators import signals as sg
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, W, ctes, frame, lag, rnd, roll, tidy
from candlewick.sources.market import supplier_bars

BENCH, DAY, STEADY, FLOW = "1", 15, 0.1, -3.0
D = f"close - {lag('close')}"
J = {
    "bars": SUPPLIER,
    "j0": f"""SELECT *, close / nullif({lag('close')}, 0) - 1 AS r, {lag('close', 20)} / nullif({lag('close', 41)}, 0) - 1 AS m1,
        close / nullif({lag('close', 62)}, 0) - 1 AS m3, close / nullif({lag('close', 125)}, 0) - 1 AS m6, close / nullif({lag('close', 59)}, 0) - 1 AS p60,
        {roll('avg', 'close', 20)} AS sma, {roll('stddev_samp', 'close', 20)} AS sd, {roll('max', 'high', 10)} AS h10, {roll('min', 'low', 10)} AS l10,
        {roll('avg', 'volume', 20)} AS v20, {lag('close', 19)} AS first20, {lag('volume', 19)} AS fv, close * volume AS cv, sign({D}) * volume AS flow,
        CASE WHEN {D} > 0 THEN {D} ELSE 0 END AS gain, CASE WHEN {D} < 0 THEN -({D}) ELSE 0 END AS loss,
        row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM bars""",
    "j1": f"""SELECT *, CAST(r > 0 AS DOUBLE) AS up, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al,
        {roll('stddev_samp', 'r', 63)} AS sd63, {roll('min', 'h10', 5)} AS resistance, {roll('max', 'l10', 5)} AS support,
        sum(cv) {frame(20)} / nullif(sum(volume) {frame(20)}, 0) AS vwap, {roll('sum', 'flow', 19)} AS moved FROM j0""",
    "j2": f"SELECT *, {roll('avg', 'up', 63)} AS up63, CASE WHEN al = 0 THEN 0 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi FROM j1",
    "jl": "SELECT * FROM j2 WHERE back = 1 AND n >= 100",
    "busy": """SELECT symbol, count(*) AS busy_days, avg(bc / nullif(pb, 0) - 1) AS busy_return FROM (
        SELECT a.symbol, a.close AS bc, lag(a.close) OVER (PARTITION BY a.symbol ORDER BY a.ts) AS pb FROM j0 a JOIN jl ON jl.symbol = a.symbol
        WHERE a.back <= 20 AND a.volume > 2 * jl.v20) GROUP BY symbol""",
    "season": "SELECT symbol, day(ts) AS dom, avg(r) AS m FROM j0 GROUP BY symbol, day(ts)",
    "ss": f"SELECT symbol, stddev_samp(m) AS seasonal_std, max(CASE WHEN dom = {DAY} THEN m END) AS seasonal_return FROM season GROUP BY symbol",
    "jf": f"""SELECT jl.*, busy_days, busy_return, seasonal_std, seasonal_return,
        (tanh((coalesce(p60, 0) - (SELECT p60 FROM j0 WHERE symbol = '{BENCH}' AND back = 1)) * 3) + 1) / 2 AS cycle_position FROM jl
        LEFT JOIN busy USING (symbol) LEFT JOIN ss USING (symbol)""",
    "s1": f"""SELECT symbol, 'momentum_persistence' AS signal_type, CASE WHEN score > 0.05 THEN 'bullish' WHEN score < -0.05 THEN 'bearish' ELSE 'neutral' END AS direction,
        CASE WHEN abs(score) > 0.05 THEN least(abs(score) * 5, 1) ELSE 0.5 END AS strength, steady * (1 - least(sd63 * sqrt(252) / 2, 0.8)) AS confidence,
        21 AS horizon_days, close AS entry_price, NULL::DOUBLE AS target_price, NULL::DOUBLE AS stop_loss, score AS expected_return FROM (
        SELECT *, coalesce(m1, 0) * 0.5 + coalesce(m3, 0) * 0.3 + coalesce(m6, 0) * 0.2 AS score, abs(up63 - 0.5) * 2 AS steady FROM jf) WHERE n >= 126 AND steady >= {STEADY}""",
    "s2": """SELECT symbol, 'mean_reversion' AS signal_type, CASE WHEN bull THEN 'bullish' ELSE 'bearish' END AS direction, st AS strength, st * 0.8 AS confidence,
        10 AS horizon_days, close AS entry_price, sma AS target_price, NULL::DOUBLE AS stop_loss, (sma - close) / close AS expected_return FROM (
        SELECT *, least(CASE WHEN bull THEN (30 - rsi) / 30 + 0.1 - band ELSE (rsi - 70) / 30 + band - 0.9 END, 1) AS st FROM (
        SELECT *, (rsi < 30 OR band < 0.1) AND close < sma AS bull, (rsi > 70 OR band > 0.9) AND close > sma AS bear FROM (
        SELECT *, (close - (sma - 2 * sd)) / nullif(4 * sd, 0) AS band FROM jf)) WHERE bull OR bear)""",
    "s3": """SELECT symbol, 'breakout' AS signal_type, CASE WHEN below THEN 'bearish' ELSE 'bullish' END AS direction, least((CASE WHEN below THEN dn ELSE up_ END) * 10, 1) AS strength,
        least((CASE WHEN below THEN dn ELSE up_ END) * 10, 1) * 0.7 AS confidence, 14 AS horizon_days, close AS entry_price, tg AS target_price,
        CASE WHEN below THEN support * 1.02 ELSE resistance * 0.98 END AS stop_loss, (tg - close) / close AS expected_return FROM (
        SELECT *, CASE WHEN below THEN support * (1 - dn) ELSE resistance * (1 + up_) END AS tg FROM (
        SELECT *, dn > 0.02 AND volume > v20 * 1.5 AS below, up_ > 0.02 AND volume > v20 * 1.5 AS above FROM (
        SELECT *, (close - resistance) / resistance AS up_, (support - close) / support AS dn FROM jf)) WHERE below OR above)""",
    "s4": f"""SELECT symbol, 'volume_flow' AS signal_type, 'bullish' AS direction, least(abs(flw - price), 1) AS strength, least(abs(flw - price), 1) * 0.6 AS confidence,
        7 AS horizon_days, close AS entry_price, vwap AS target_price, NULL::DOUBLE AS stop_loss, (vwap - close) / close AS expected_return FROM (
        SELECT *, close / first20 - 1 AS price, CASE WHEN fv <> 0 THEN (fv + moved) / fv - 1 ELSE 0 END AS flw FROM jf)
        WHERE flw > price + ({FLOW}) AND close < vwap AND busy_days > 0 AND busy_return > 0""",
    "s5": """SELECT symbol, 'cycle_signal' AS signal_type, CASE WHEN seasonal_return > 0 THEN 'bullish' WHEN seasonal_return < 0 THEN 'bearish' ELSE 'neutral' END AS direction,
        abs(seasonal_return / nullif(seasonal_std, 0)) AS strength, abs(seasonal_return / nullif(seasonal_std, 0)) * cycle_position * 0.5 AS confidence, 30 AS horizon_days,
        close AS entry_price, NULL::DOUBLE AS target_price, NULL::DOUBLE AS stop_loss, seasonal_return AS expected_return FROM jf
        WHERE n >= 252 AND abs(seasonal_return / nullif(seasonal_std, 0)) >= 0.25""",
    "every": " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, 6)),
    "signals": """SELECT *, CASE signal_type WHEN 'momentum_persistence' THEN 0.25 WHEN 'mean_reversion' THEN 0.2 WHEN 'breakout' THEN 0.2
        WHEN 'volume_flow' THEN 0.15 ELSE 0.1 END AS wt FROM every WHERE strength > 0 AND strength <= 1 AND confidence > 0 AND confidence <= 1
        AND coalesce(abs(expected_return) <= 2, true)""",
}
OUT = "symbol, signal_type, direction, horizon_days, " + rnd("strength confidence entry_price target_price stop_loss expected_return")
for _i, (_name, _col) in enumerate((("momentum_persistence", lambda: sg.momentum_persistence(STEADY)), ("mean_reversion_signal", sg.mean_reversion),
                                    ("breakout_signal", sg.breakout), ("volume_flow_signal", lambda: sg.volume_flow(FLOW)), ("cycle_signal", sg.cycle)), 1):
    register(f"J{_i}_{_name}", lambda spark, d, col=_col: rounded(sg.rows_of(sg.features(supplier_bars(spark, d), BENCH, DAY), col())),
             ctes(f"SELECT {OUT} FROM s{_i}", **J))


def signals_of(spark, d):
    return sg.all_signals(supplier_bars(spark, d), BENCH, DAY, STEADY, FLOW)


register("J6_signal_features", lambda spark, d: rounded(sg.signal_features(supplier_bars(spark, d))), ctes(
    f"""SELECT symbol, {tidy('avg(q)')} AS mean_return, {tidy('stddev_samp(q)')} AS volatility, {tidy('avg(volume)')} AS mean_volume,
    {tidy('arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1')} AS period_return FROM (SELECT *, close / nullif({lag('close')}, 0) - 1 AS q FROM j0 WHERE back <= 30) GROUP BY symbol""",
    bars=SUPPLIER, j0=J["j0"]))
register("J7_validate_signals", lambda spark, d: rounded(signals_of(spark, d)), ctes(f"SELECT {OUT} FROM signals", **J))
register("J8_combine_signals", lambda spark, d: rounded(sg.combine(signals_of(spark, d))), ctes(
    f"""SELECT symbol, CASE WHEN b > e * 1.2 THEN 'bullish' WHEN e > b * 1.2 THEN 'bearish' ELSE 'neutral' END AS direction,
    {tidy('CASE WHEN b > e * 1.2 THEN b / (b + e) WHEN e > b * 1.2 THEN e / (b + e) ELSE 0.5 END')} AS strength, {rnd('confidence')}, horizon_days, {rnd('expected_return')}, signals FROM (
    SELECT symbol, coalesce(sum(strength * confidence * wt) FILTER (direction = 'bullish'), 0) AS b, coalesce(sum(strength * confidence * wt) FILTER (direction = 'bearish'), 0) AS e,
    sum(confidence * wt) / sum(wt) AS confidence, CAST(floor(avg(horizon_days)) AS BIGINT) AS horizon_days, avg(expected_return) AS expected_return, count(*) AS signals FROM signals GROUP BY symbol)""", **J))
register("J9_signal_summary", lambda spark, d: rounded(sg.summary(signals_of(spark, d))), ctes(
    f"""SELECT coalesce(signal_type, 'all') AS signal_type, coalesce(direction, 'all') AS direction, count(*) AS signals, count(DISTINCT symbol) AS assets,
    {tidy('avg(confidence)')} AS avg_confidence, {tidy('avg(strength)')} AS avg_strength FROM signals GROUP BY ROLLUP (signal_type, direction)""", **J))
register("J9_top_signals", lambda spark, d: rounded(sg.top_signals(signals_of(spark, d))), ctes(
    f"SELECT symbol, signal_type, direction, {rnd('strength confidence')} FROM (SELECT * FROM signals ORDER BY confidence * strength DESC, symbol, signal_type LIMIT 10)", **J))
