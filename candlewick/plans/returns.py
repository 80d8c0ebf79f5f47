"""Queries F1-F8, F13-F15, F18, F20: returns and risk."""

from __future__ import annotations

from candlewick.functions.guards import rounded
from candlewick.operators import cleaning as cl
from candlewick.operators import returns as rt
from candlewick.plans.common import rowwise
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SEGMENT, SUPPLIER, W, ctes, div, frame, lag, panel, rnd, roll, tidy
from candlewick.sources.market import segment_bars, supplier_bars

PC = lag("close")
LN = {"l": f"SELECT *, ln({div('close', PC)}) AS log_return, {div('close', PC)} - 1 AS simple_return FROM bars"}


def _close(bars):
    """What the series functions read: all columns of their input go through Python."""
    return bars.select("symbol", "ts", "close")


rowwise("F1_returns", lambda b: rt.log_returns(rt.simple_returns(b)), ["simple_return", "log_return"],
        "SELECT symbol, ts, simple_return, log_return FROM l", **LN)
rowwise("F2_cumulative_return", rt.cumulative_return, ["cumulative_return"],
        f"SELECT symbol, ts, CASE WHEN simple_return IS NOT NULL THEN 100 * (exp(sum(log_return) OVER {W}) - 1) END AS cumulative_return FROM l",
        **LN)
rowwise("F3_base_return", rt.base_return, ["base_return"],
        f"SELECT symbol, ts, 100 * (close - {PC}) / nullif(first_value(close) OVER {W}, 0) AS base_return FROM bars")
WIN = (30, 60, 90, 180, 252)
rowwise("F4_rolling_volatility", lambda b: rt.rolling_volatility(_close(b)), [f"volatility_{n}" for n in WIN],
        "SELECT symbol, ts, " + ", ".join(f"{roll('stddev_samp', 'log_return', n)} * sqrt(252) AS volatility_{n}" for n in WIN)
        + " FROM l", **LN)
rowwise("F5_rolling_sharpe", lambda b: rt.rolling_sharpe(_close(b)), [f"sharpe_{n}" for n in WIN],
        "SELECT symbol, ts, " + ", ".join(
            f"({roll('avg', 'log_return', n)} * 252 - 0.02) / nullif({roll('stddev_samp', 'log_return', n)} * sqrt(252), 0) AS sharpe_{n}"
            for n in WIN) + " FROM l", **LN)
DD = {"dd": f"SELECT *, close / nullif(max(close) OVER {W}, 0) - 1 AS drawdown FROM bars"}
rowwise("F6_drawdown", rt.drawdown, ["drawdown", "max_drawdown"],
        f"SELECT symbol, ts, drawdown, min(drawdown) OVER {W} AS max_drawdown FROM dd", **DD)
rowwise("F7_calmar", rt.calmar, ["calmar"],
        f"SELECT symbol, ts, m * 252 / nullif(abs(min(drawdown) OVER {W}), 0) AS calmar FROM dd JOIN "
        "(SELECT symbol, avg(log_return) AS m FROM l GROUP BY symbol) USING (symbol)", digits=4, **DD, **LN)
rowwise("F8_rolling_moments", lambda b: rt.rolling_moments(_close(b)), ["skew_60", "kurt_60"],
        f"SELECT symbol, ts, {roll('skewness', 'log_return', 60)} AS skew_60, {roll('kurtosis', 'log_return', 60)} AS kurt_60 FROM l",
        **LN)


def tail(src: str, levels=(95, 99)) -> dict[str, str]:
    f = frame(252)
    out = {"tw": f"SELECT symbol, ts, log_return, CASE WHEN count(log_return) {f} = 252 THEN list(log_return) FILTER (log_return IS NOT NULL) {f} END AS w, "
                 + ", ".join(f"{roll('quantile_cont({x}, ' + str(round(1 - p / 100, 2)) + ')', 'log_return', 252)} AS var_{p}" for p in levels)
                 + f" FROM {src}",
           "tv": "SELECT symbol, ts, log_return, " + ", ".join(
               f"var_{p}, list_avg(list_filter(w, lambda x: x <= var_{p})) AS cvar_{p}" for p in levels) + " FROM tw"}
    return out


rowwise("F13_hist_var", rt.tail_risk, ["var_95", "var_99"], "SELECT symbol, ts, var_95, var_99 FROM tv", **LN, **tail("l"))
rowwise("F14_hist_cvar", rt.tail_risk, ["cvar_95", "cvar_99"], "SELECT symbol, ts, cvar_95, cvar_99 FROM tv", **LN, **tail("l"))

PANEL = {"bars": panel(SEGMENT), **LN}
BOTH = {**PANEL, "joined": """SELECT a.symbol, a.ts, a.log_return AS y, b.log_return AS x FROM l a JOIN l b USING (ts)
    WHERE b.symbol = 'BUILDING' AND a.symbol <> 'BUILDING' AND a.log_return IS NOT NULL AND b.log_return IS NOT NULL"""}


def weekly(spark, d):
    return cl.panel(segment_bars(spark, d))


register("F15_rolling_beta", lambda spark, d: rounded(rt.rolling_beta(rt.log_returns(weekly(spark, d)), "BUILDING").select(
    "symbol", "ts", "beta")), ctes(
    f"""SELECT symbol, ts, {tidy(f"CASE WHEN count(x) {frame(60)} = 60 THEN covar_samp(y, x) {frame(60)} / nullif(var_pop(x) {frame(60)}, 0) END")} AS beta
    FROM joined""", **BOTH))
register("F20_ols_alpha_beta", lambda spark, d: rounded(rt.alpha_beta(rt.log_returns(weekly(spark, d)), "BUILDING")), ctes(
    f"SELECT symbol, count(*) AS n, {tidy('regr_intercept(y, x)')} AS alpha, {tidy('regr_slope(y, x)')} AS beta FROM joined GROUP BY symbol",
    **BOTH))
register("F18_stat_summary", lambda spark, d: rounded(rt.stat_summary(supplier_bars(spark, d))), ctes(
    f"""SELECT symbol, {tidy('avg(log_return)')} AS mean_return, {tidy('avg(log_return) * 252')} AS annual_return,
    {tidy('stddev_samp(log_return)')} AS volatility, {tidy('stddev_samp(log_return) * sqrt(252)')} AS annual_volatility,
    {tidy('(avg(log_return) * 252 - 0.02) / nullif(stddev_samp(log_return) * sqrt(252), 0)')} AS sharpe,
    {tidy('skewness(log_return)')} AS skewness, {tidy('kurtosis(log_return)')} AS kurtosis,
    {tidy('arg_max(var_95, ts)')} AS var_95, {tidy('arg_max(cvar_95, ts)')} AS cvar_95, {tidy('min(log_return)')} AS min_return,
    count(log_return) AS observations, max(CASE WHEN log_return IS NOT NULL THEN ts END) AS latest,
    {tidy('100.0 * count_if(log_return IS NULL) / count(*)')} AS missing_pct FROM tv GROUP BY symbol""",
    bars=SUPPLIER, **LN, **tail("l", (95,))))
