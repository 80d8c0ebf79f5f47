"""Queries H1-H12: factor scores over the weekly supplier panel."""

from __future__ import annotations

from candlewick.functions.guards import rounded
from candlewick.operators import cleaning as cl
from candlewick.operators import scoring as sc
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, W, ctes, lag, panel, rnd, roll, tidy
from candlewick.sources.market import supplier_bars

BENCH = "1"


def weekly(spark, d):
    return cl.panel(supplier_bars(spark, d))


D = f"close - {lag('close')}"
H = {
    "bars": panel(SUPPLIER),
    "hx": "SELECT *, " + ", ".join(f"close / nullif({lag('close', n - 1)}, 0) - 1 AS p{n}, close / nullif({lag('close', n)}, 0) - 1 AS c{n}"
                                   for n in (21, 63, 126)) +
          f""", close / nullif({lag('close')}, 0) - 1 AS r, close / nullif({lag('close', 29)}, 0) - 1 AS p30,
          {roll('avg', 'volume', 5)} AS v5, {roll('avg', 'volume', 7)} AS v7, {roll('avg', 'volume', 30)} AS v30, {roll('stddev_samp', 'volume', 30)} AS vs30,
          {roll('avg', 'close', 20)} AS m20, {roll('stddev_samp', 'close', 20)} AS s20,
          CASE WHEN {D} > 0 THEN {D} ELSE 0 END AS gain, CASE WHEN {D} < 0 THEN -({D}) ELSE 0 END AS loss,
          row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM bars""",
    "hy": f"""SELECT *, {roll('stddev_samp', 'r', 30)} * sqrt(252) AS vol, {roll('avg', 'r', 30)} AS rmean, {roll('stddev_samp', 'r', 30)} AS rsd,
          {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al FROM hx""",
    "hl": "SELECT *, CASE WHEN al = 0 THEN 0 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi FROM hy WHERE back = 1",
    "ha": """SELECT symbol, stddev_samp(c21) AS s21, stddev_samp(c63) AS s63, stddev_samp(c126) AS s126, median(vol) AS vmed, median(volume) AS vmedian FROM hy GROUP BY symbol""",
    "tail": "SELECT symbol, ts, r FROM hx WHERE back <= 60 AND r IS NOT NULL",
    "cp": """SELECT a.symbol, abs(CASE WHEN var_pop(a.r) > 1e-18 AND var_pop(b.r) > 1e-18 THEN corr(a.r, b.r) END) AS c FROM tail a JOIN tail b ON a.ts = b.ts AND a.symbol <> b.symbol
          GROUP BY a.symbol, b.symbol HAVING count(*) >= 20""",
    "f1": """SELECT symbol, (tanh((p21 / greatest(s21 * sqrt(252), 0.01) + 0.94 * p63 / greatest(s63 * sqrt(252), 0.01)
          + 0.94 * 0.94 * p126 / greatest(s126 * sqrt(252), 0.01)) / (1 + 0.94 + 0.94 * 0.94)) + 1) / 2 AS momentum FROM hl JOIN ha USING (symbol)""",
    "f2": """SELECT symbol, least(greatest((100 - coalesce(rsi, 50)) / 100 * 0.6 + (CASE WHEN m20 IS NULL THEN 0.5 ELSE 1 - (close - (m20 - 2 * s20)) / nullif((m20 + 2 * s20) - (m20 - 2 * s20), 0) END) * 0.4, 0), 1) AS mean_reversion FROM hl""",
    "f3": """SELECT symbol, least(greatest((CASE WHEN vs30 > 0 THEN least(abs((v5 - v30) / vs30) / 2, 1) ELSE 0 END) * 0.4
          + least(ln(1 + v5) / nullif(ln(1 + v30 * 10), 0), 1) * 0.6, 0), 1) AS volume_liquidity FROM hl""",
    "f4": """SELECT symbol, least(greatest(CASE WHEN q > 1.5 THEN 1 / (1 + q - 1.5) ELSE 0.5 + 0.5 * (1.5 - q) / 1.5 END, 0), 1) AS volatility_regime
          FROM (SELECT symbol, CASE WHEN vmed > 0 THEN vol / vmed ELSE 1 END AS q FROM hl JOIN ha USING (symbol))""",
    "f5": """SELECT symbol, coalesce(1 - least(c, 0.5), 0.5) AS correlation_dynamics FROM (SELECT DISTINCT symbol FROM bars)
          LEFT JOIN (SELECT symbol, avg(c) AS c FROM cp GROUP BY symbol) USING (symbol)""",
    "f6": f"SELECT symbol, (tanh((p30 - (SELECT p30 FROM hl WHERE symbol = '{BENCH}')) * 5) + 1) / 2 AS market_cycle FROM hl",
    "f7": "SELECT symbol, least(greatest(least(CASE WHEN vmedian > 0 THEN v7 / vmedian ELSE 1 END, 2) / 2, 0), 1) AS local_factors FROM hl JOIN ha USING (symbol)",
    "comp": "SELECT *, least(greatest(0.4 * momentum + 0.2 * mean_reversion + 0.1 * volume_liquidity + 0.1 * volatility_regime "
            "+ 0.1 * correlation_dynamics + 0.05 * market_cycle + 0.05 * local_factors, 0), 1) AS composite_score FROM (SELECT symbol FROM hl WHERE n >= 156) "
            + " ".join(f"JOIN f{i} USING (symbol)" for i in range(1, 8)),
    "scores": "SELECT *, 100 * cume_dist() OVER (ORDER BY composite_score) AS percentile_rank FROM comp",
}
NAMES = list(sc.WEIGHTS)
for _i, (_n, _f) in enumerate((
        *[(n, lambda b, n=n: sc.one_factor(b, n)) for n in ("momentum", "mean_reversion", "volume_liquidity", "volatility_regime")],
        ("correlation_dynamics", sc.correlation_score), ("market_cycle", lambda b: sc.cycle_score(b, BENCH)),
        ("local_factors", lambda b: sc.one_factor(b, "local_factors"))), 1):
    register(f"H{_i}_{_n}", lambda spark, d, f=_f: rounded(f(weekly(spark, d))), ctes(f"SELECT symbol, {rnd(_n)} FROM f{_i}", **H))


def scores_of(spark, d):
    return sc.composite(weekly(spark, d), BENCH)


register("H8_composite_score", lambda spark, d: rounded(scores_of(spark, d).drop("percentile_rank")), ctes(
    f"SELECT symbol, {rnd(' '.join(NAMES))}, {rnd('composite_score')} FROM scores", **H))
register("H9_percentile_rank", lambda spark, d: rounded(scores_of(spark, d).select("symbol", "percentile_rank")), ctes(
    f"SELECT symbol, {rnd('percentile_rank')} FROM scores", **H))
register("H10_score_breakdown", lambda spark, d: rounded(sc.breakdown(weekly(spark, d))), ctes(
    f"""SELECT symbol, {', '.join(f"{tidy(f'p{n}')} AS return_{n}d" for n in (21, 63, 126))}, {tidy('coalesce(rsi, 50)')} AS rsi, coalesce(rsi, 50) < 30 AS rsi_oversold,
    coalesce(rsi, 50) > 70 AS rsi_overbought, {tidy('rsd * sqrt(252)')} AS volatility_30d, {tidy('abs(dd)')} AS max_drawdown_30d,
    {tidy('coalesce((rmean * 252 - 0.02) / nullif(rsd * sqrt(252), 0), 0)')} AS sharpe_30d FROM hl JOIN (SELECT symbol, min(close / m - 1) AS dd FROM (
    SELECT symbol, close, max(close) OVER {W} AS m FROM hx WHERE back <= 30) GROUP BY symbol) USING (symbol)""", **H))
register("H11_top_assets", lambda spark, d: rounded(sc.top_assets(scores_of(spark, d)).select("symbol", "composite_score", "percentile_rank")), ctes(
    f"SELECT symbol, {rnd('composite_score percentile_rank')} FROM (SELECT * FROM scores ORDER BY composite_score DESC, symbol LIMIT 10)", **H))
register("H12_scoring_summary", lambda spark, d: rounded(sc.summary(scores_of(spark, d))), ctes(
    f"""SELECT count(*) AS total_assets, {tidy('avg(composite_score)')} AS mean, {tidy('stddev_pop(composite_score)')} AS std, {tidy('min(composite_score)')} AS min,
    {tidy('max(composite_score)')} AS max, {tidy('median(composite_score)')} AS median, {', '.join(f"{tidy(f'avg({n})')} AS avg_{n}" for n in NAMES)},
    (SELECT string_agg(symbol, ',' ORDER BY composite_score DESC, symbol) FROM (SELECT symbol, composite_score FROM scores ORDER BY composite_score DESC, symbol LIMIT 10)) AS top_assets FROM scores""", **H))
