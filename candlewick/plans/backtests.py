"""Queries O1-O9: backtests over daily supplier bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import backtest as bt
from candlewick.plans.common import rowwise, whole
from candlewick.plans.indicators import RSI, gain_loss
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, W, ctes, lag, rnd, roll, tidy
from candlewick.sources.market import supplier_bars

PC = lag("close")
rowwise("O1_sma_cross_signal", bt.sma_cross(20, 50), ["signal"],
        f"SELECT symbol, ts, CAST(coalesce(sign({roll('avg', 'close', 20)} - {roll('avg', 'close', 50)}), 0) AS DOUBLE) AS signal FROM bars")
RS = {**gain_loss("NULL"), "rs": f"SELECT symbol, ts, close, {RSI} AS rsi FROM gl",
      "sig": "SELECT symbol, ts, close, CASE WHEN rsi < 30 THEN 1.0 WHEN rsi > 70 THEN -1.0 ELSE 0.0 END AS signal FROM rs"}
rowwise("O2_rsi_reversion_signal", bt.rsi_reversion(), ["signal"], "SELECT symbol, ts, signal FROM sig", **RS)
RUN = {"pos": f"SELECT *, coalesce(lag(signal) OVER {W}, 0) AS position, coalesce(ln(close / nullif({PC}, 0)), 0) AS log_return FROM sig",
       "cst": f"SELECT *, coalesce(abs(position - lag(position) OVER {W}), 0) * 0.0005 AS cost FROM pos",
       "net": "SELECT *, log_return * position - cost AS net_return FROM cst"}
# compared on the log scale: these synthetic prices compound to astronomic equity
rowwise("O3_backtest", lambda b: bt.backtest(b, bt.rsi_reversion()).withColumn("log_equity", F.log("equity")),
        ["position", "log_return", "cost", "net_return", "log_equity"],
        f"SELECT *, sum(net_return) OVER {W} AS log_equity FROM net", **RS, **RUN)
STATS = (f"{tidy('sum(net_return)')} AS log_growth, {tidy('avg(net_return) * 365')} AS annual_return, "
         f"{tidy('stddev_pop(net_return) * sqrt(365)')} AS annual_volatility, {tidy('coalesce(avg(net_return) * 365 / nullif(stddev_pop(net_return) * sqrt(365), 0), 0)')} AS sharpe")
def _stats(spark, d, strategy):
    out = bt.backtest_stats(bt.backtest(supplier_bars(spark, d), strategy))
    return rounded(out.drop("total_return"))


register("O4_backtest_stats", lambda spark, d: _stats(spark, d, bt.rsi_reversion()), ctes(
    f"SELECT symbol, {STATS} FROM net GROUP BY symbol", bars=SUPPLIER, **RS, **RUN))


def above_mean(bars):
    """A caller's own strategy: long above the 10-bar mean."""
    from candlewick.functions.windows import over
    return bars.withColumn("signal", F.when(F.col("close") > over(bars).mean("close", 10), 1.0).otherwise(0.0))


register("O5_custom_strategy", lambda spark, d: _stats(spark, d, above_mean), ctes(
    f"SELECT symbol, {STATS} FROM net GROUP BY symbol", bars=SUPPLIER,
    sig=f"SELECT symbol, ts, close, CASE WHEN close > {roll('avg', 'close', 10)} THEN 1.0 ELSE 0.0 END AS signal FROM bars", **RUN))


def trips(fast: int, slow: int, tag: str = "") -> dict[str, str]:
    return {f"fl{tag}": f"SELECT symbol, ts, close, coalesce({roll('avg', 'close', fast)} > {roll('avg', 'close', slow)}, false)::INT AS above FROM bars",
            f"tu{tag}": f"SELECT * FROM (SELECT *, above - lag(above) OVER {W} AS turn FROM fl{tag}) WHERE turn <> 0",
            f"tr{tag}": f"""SELECT symbol, ets AS entry_ts, ts AS exit_ts, ep AS entry_price, close AS exit_price, close - ep AS gain FROM (
                SELECT *, lag(ts) OVER {W} AS ets, lag(close) OVER {W} AS ep, lag(turn) OVER {W} AS pt FROM tu{tag}) WHERE turn = -1 AND pt = 1"""}


T39 = trips(3, 9)


def trades_of(spark, d):
    return bt.round_trips(bt.cross_flags(supplier_bars(spark, d)))


whole("above", "turn")
register("O6_cross_trades", lambda spark, d: trades_of(spark, d), ctes("SELECT * FROM tr", bars=SUPPLIER, **T39))
register("O7_trade_metrics", lambda spark, d: rounded(bt.trade_metrics(trades_of(spark, d))), ctes(
    f"""SELECT symbol, count(*) AS trades, {tidy('avg((gain > 0)::INT)')} AS hit_rate, {tidy('avg(gain)')} AS payoff, {tidy('sum(gain)')} AS total,
    CAST(sum(date_diff('day', entry_ts, exit_ts)) AS BIGINT) AS exposure_days FROM tr GROUP BY symbol""", bars=SUPPLIER, **T39))
DROP = """SELECT {k}, n, total, max(total) OVER w AS peak, first_value(n) OVER (PARTITION BY {k}, total ORDER BY n) AS nn FROM (
    SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY exit_ts) AS n, sum(gain) OVER (PARTITION BY {k} ORDER BY exit_ts) AS total FROM {t})
    WINDOW w AS (PARTITION BY {k} ORDER BY n)"""
register("O8_trade_drawdown", lambda spark, d: rounded(bt.trade_drawdown(trades_of(spark, d))), ctes(
    f"""SELECT c.symbol, {tidy('c.peak - c.total')} AS max_drawdown, CAST((SELECT min(x.n) FROM cum x WHERE x.symbol = c.symbol AND x.total = c.peak) AS INTEGER) AS start_trade,
    CAST(c.n AS INTEGER) AS end_trade FROM cum c QUALIFY row_number() OVER (PARTITION BY c.symbol ORDER BY c.peak - c.total DESC, c.n) = 1""",
    bars=SUPPLIER, **T39, cum=DROP.format(k="symbol", t="tr")))

PAIRS = ((3, 9), (5, 20), (9, 21))


def _scorecard(spark, d):
    bars = supplier_bars(spark, d)
    parts = [bt.round_trips(bt.cross_flags(bars, f, s)).withColumn("strategy", F.lit(f"cross_{f}_{s}")) for f, s in PAIRS]
    return rounded(bt.scorecard(reduce(lambda a, b: a.unionByName(b), parts)), 4)


NAMES = "trades max_drawdown sharpe payoff win_loss hit_pct profit"
register("O9_trade_scorecard", _scorecard, ctes(
    f"SELECT strategy, {rnd(NAMES, 4)}, {', '.join(f'{tidy(f'{n} / nullif(max({n}) OVER (), 0)', 4)} AS {n}_scaled' for n in NAMES.split())} FROM card",
    bars=SUPPLIER, **{k: v for f, s in PAIRS for k, v in trips(f, s, f"_{f}_{s}").items()},
    every=" UNION ALL ".join(f"SELECT *, 'cross_{f}_{s}' AS strategy FROM tr_{f}_{s}" for f, s in PAIRS),
    cum=DROP.format(k="strategy, symbol", t="every"),
    fall="SELECT strategy, max(peak - total) AS max_drawdown FROM cum GROUP BY strategy",
    card="""SELECT strategy, CAST(count(*) AS DOUBLE) AS trades, avg(gain) / nullif(stddev_pop(gain), 0) AS sharpe, avg(gain) AS payoff,
        count_if(gain > 0) / CAST(nullif(count_if(gain <= 0), 0) AS DOUBLE) AS win_loss, 100 * avg((gain > 0)::INT) AS hit_pct, sum(gain) AS profit, any_value(max_drawdown) AS max_drawdown
        FROM every JOIN fall USING (strategy) GROUP BY strategy"""))
