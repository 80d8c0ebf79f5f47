"""Queries G1-G10: market regimes per supplier series."""

from __future__ import annotations

from candlewick.functions.guards import rounded
from candlewick.operators import regimes as rg
from candlewick.plans.common import rowwise
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, W, ctes, lag, rnd, roll, tidy
from candlewick.sources.market import supplier_bars

PART = "(close / nullif(s{n}, 0) - 1 + s{n} / nullif({lag}, 0) - 1)"
SIG = {
    "sm": "SELECT *, " + ", ".join(f"{roll('avg', 'close', n)} AS s{n}" for n in (20, 50, 200)) +
          f", close / nullif({lag('close')}, 0) - 1 AS r, {roll('avg', 'volume', 5)} AS v5, {roll('avg', 'volume', 30)} AS v30, "
          f"row_number() OVER {W} AS n FROM bars",
    "tp": "SELECT *, " + ", ".join(f"{PART.format(n=n, lag=lag(f's{n}', 4))} AS t{n}" for n in (20, 50, 200)) +
          f", {roll('stddev_samp', 'r', 30)} * sqrt(252) AS vol FROM sm",
    "sg": f"""SELECT *, tanh(10 * ((coalesce(20 * t20, 0) + coalesce(50 * t50, 0) + coalesce(200 * t200, 0)) / nullif(
        (CASE WHEN t20 IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN t50 IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN t200 IS NOT NULL THEN 200 ELSE 0 END), 0))) AS trend_signal,
        CASE WHEN v30 > 0 THEN least(greatest(v5 / v30 / 1.5, 0), 1) WHEN v30 IS NOT NULL THEN 1 / 1.5 END AS volume_signal,
        median(vol) OVER {W} AS med FROM tp""",
    "sv": """SELECT *, CASE WHEN vol IS NOT NULL THEN least(greatest(((CASE WHEN med > 0 THEN vol / med ELSE 1 END) - 0.5) / 1.5, 0), 1) END AS volatility_signal FROM sg""",
}


def classify(trend: str, vol: str, volume: str, short: str) -> str:
    """CASE columns regime, confidence, strength."""
    t = f"({trend} * 0.4)"
    conf = (f"(CASE WHEN {vol} > 0.8 THEN {vol} WHEN abs({t}) < 0.1 THEN 1 - abs({t}) * 5 WHEN abs({t}) > 0.02 THEN least(abs({t}) * 2, 1) ELSE 0.5 END)")
    return f"""CASE WHEN {short} OR {conf} < 0.6 THEN 'unknown' WHEN {vol} > 0.8 THEN 'volatile' WHEN abs({t}) < 0.1 THEN 'sideways'
        WHEN {t} > 0.02 THEN 'bull' WHEN {t} < -0.02 THEN 'bear' ELSE 'sideways' END AS regime,
      CASE WHEN {short} OR {conf} < 0.6 THEN 0 ELSE {conf} END AS confidence,
      CASE WHEN {short} OR {conf} < 0.6 THEN 0 WHEN {vol} > 0.8 THEN {vol} WHEN abs({t}) < 0.1 THEN {volume} * 0.2
        WHEN {t} > 0.02 THEN abs({t}) * (1 - {vol} * 0.5) WHEN {t} < -0.02 THEN abs({t}) * (1 - {vol} * 0.3) ELSE 0.5 END AS strength"""


REG = {**SIG, "reg": f"SELECT symbol, ts, trend_signal, volatility_signal, volume_signal, {classify('trend_signal', 'volatility_signal', 'volume_signal', 'n < 230')} FROM sv"}
rowwise("G1_trend_signal", rg.trend_signal, ["trend_signal"], "SELECT symbol, ts, trend_signal FROM sv", **SIG)
rowwise("G2_volatility_signal", lambda b: rg.volatility_signal(b.select("symbol", "ts", "close")), ["volatility_signal"], "SELECT symbol, ts, volatility_signal FROM sv", **SIG)
rowwise("G3_volume_signal", rg.volume_signal, ["volume_signal"], "SELECT symbol, ts, volume_signal FROM sv", **SIG)


def _traded(spark, d):
    """Bars with what the signals read: all columns of a series go through Python."""
    return supplier_bars(spark, d).select("symbol", "ts", "close", "volume")


register("G4_latent_state", lambda spark, d: rg.latent_states(supplier_bars(spark, d)))
register("G5_classify_regime", lambda spark, d: rounded(rg.signals(_traded(spark, d))), ctes(
    f"SELECT symbol, ts, {rnd('trend_signal volatility_signal volume_signal')}, regime, {rnd('confidence strength')} FROM reg", bars=SUPPLIER, **REG))

LATEST = {**SIG,
          "lst": "SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
          "pct": """SELECT a.symbol, count_if(a.vol <= l.vol) / CAST(count(*) - 1 AS DOUBLE) AS volatility_percentile,
              count_if(a.volume <= l.v5) / CAST(count(*) AS DOUBLE) AS volume_percentile FROM sv a JOIN lst l USING (symbol) GROUP BY a.symbol"""}
register("G6_percentiles", lambda spark, d: rounded(rg.latest_signals(supplier_bars(spark, d)).select(
    "symbol", "volatility_percentile", "volume_percentile")), ctes(
    f"SELECT symbol, {rnd('volatility_percentile volume_percentile')} FROM pct", bars=SUPPLIER, **LATEST))

HIST = {**REG,
        "h0": f"SELECT *, lag(regime) OVER {W} AS before, row_number() OVER {W} AS n, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM reg",
        "h1": f"""SELECT *, last_value(CASE WHEN regime <> before THEN ts END IGNORE NULLS) OVER {W} AS change_date,
            last_value(CASE WHEN regime <> before THEN before END IGNORE NULLS) OVER {W} AS previous_regime FROM h0""",
        "hist": """SELECT symbol, ts, regime, confidence, strength, change_date, previous_regime, back,
            coalesce(date_diff('day', change_date, ts), n - 1) AS duration_days FROM h1 WHERE back <= 100"""}


def hist_of(spark, d):
    return rg.history(rg.signals(_traded(spark, d)))


register("G7_regime_history", lambda spark, d: rounded(hist_of(spark, d)), ctes(
    f"SELECT symbol, ts, regime, {rnd('confidence strength')}, change_date, previous_regime, duration_days FROM hist", bars=SUPPLIER, **HIST))
register("G8_regime_summary", lambda spark, d: rounded(rg.summary(hist_of(spark, d))), ctes(
    f"""SELECT symbol, arg_max(regime, ts) AS current_regime, {tidy('arg_max(confidence, ts)')} AS confidence, {tidy('arg_max(strength, ts)')} AS strength,
    arg_max(duration_days, ts) AS duration_days, arg_max_null(previous_regime, ts) AS previous_regime,
    {', '.join(f"count_if(regime = '{r}') AS seen_{r}" for r in rg.REGIMES)} FROM hist WHERE back <= 30 GROUP BY symbol""", bars=SUPPLIER, **HIST))
register("G9_transition_probability", lambda spark, d: rounded(rg.transitions(hist_of(spark, d))), ctes(
    f"""SELECT symbol, from_regime, regime AS to_regime, count(*) AS steps, {tidy('count(*) / CAST(any_value(k) - 1 AS DOUBLE)')} AS probability FROM (
    SELECT *, lag(regime) OVER {W} AS from_regime, count(*) OVER (PARTITION BY symbol) AS k FROM hist) WHERE from_regime IS NOT NULL AND k >= 10
    GROUP BY symbol, from_regime, regime""", bars=SUPPLIER, **HIST))
register("G10_detect_regime", lambda spark, d: rounded(rg.detect(supplier_bars(spark, d))), ctes(
    f"""SELECT symbol, ts, regime, {rnd('confidence strength trend_signal volatility_signal volume_signal')}, {tidy('abs(trend_signal)')} AS trend_strength,
    {rnd('volatility_percentile volume_percentile')} FROM reg JOIN (SELECT symbol, ts FROM lst) USING (symbol, ts) JOIN pct USING (symbol)""",
    bars=SUPPLIER, **REG, **{k: LATEST[k] for k in ("lst", "pct")}))
