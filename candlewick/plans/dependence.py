"""Queries D13, D14, D17, F9-F12, F16, F17, F19, T3, T10: dependence between assets on the weekly panels."""

from __future__ import annotations

from candlewick.functions.blocks import pair_list
from candlewick.functions.guards import rounded
from candlewick.operators import cleaning as cl
from candlewick.operators import dependence as dp
from candlewick.operators import unitroot as ur
from candlewick.plans.registry import register
from candlewick.plans.sqltext import NATION, SEGMENT, SUPPLIER, ctes, flag, frame, lag, panel, rnd, tidy
from candlewick.sources.market import nation_bars, segment_bars, supplier_bars

R = {"r0": f"SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS ret FROM bars",
     "r1": "SELECT * FROM r0 WHERE ret IS NOT NULL",
     "r": "SELECT symbol, ts, ret FROM r1 WHERE ts IN (SELECT ts FROM r1 GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM r1))"}
NAT = {"bars": panel(NATION), **R}
SEG = {"bars": panel(SEGMENT), **R}
PAIRS = "FROM r a JOIN r b ON a.ts = b.ts AND a.symbol {} b.symbol GROUP BY a.symbol, b.symbol"


def nations(spark, d):
    return cl.panel(nation_bars(spark, d))


def segments(spark, d):
    return cl.panel(segment_bars(spark, d))


register("D13_returns_matrix", lambda spark, d: rounded(dp.returns_matrix(nations(spark, d))),
         ctes(f"SELECT symbol, ts, {rnd('ret')} FROM r", **NAT))
register("D13_corr_matrix", lambda spark, d: rounded(dp.corr_matrix(dp.returns_matrix(nations(spark, d)))), ctes(
    f"SELECT a.symbol AS asset_i, b.symbol AS asset_j, {tidy('corr(a.ret, b.ret)')} AS corr {PAIRS.format('<=')} HAVING count(*) > 30", **NAT))
register("D13_cov_matrix", lambda spark, d: rounded(dp.cov_matrix(dp.returns_matrix(nations(spark, d)))), ctes(
    f"SELECT a.symbol AS asset_i, b.symbol AS asset_j, {tidy('covar_samp(a.ret, b.ret) * 252')} AS cov {PAIRS.format('<=')} HAVING count(*) > 30", **NAT))
CM = {"cm": f"SELECT a.symbol AS asset_i, b.symbol AS asset_j, corr(a.ret, b.ret) AS corr {PAIRS.format('<')} HAVING count(*) > 30"}
register("D14_corr_summary", lambda spark, d: rounded(dp.corr_summary(dp.corr_matrix(dp.returns_matrix(nations(spark, d))))), ctes(
    f"SELECT {tidy('avg(corr)')} AS avg_correlation, {tidy('max(corr)')} AS max_correlation, {tidy('min(corr)')} AS min_correlation, "
    f"{tidy('stddev_pop(corr)')} AS correlation_std FROM cm", **NAT, **CM))


def _rolling(spark, d):
    r = dp.returns_matrix(nations(spark, d))
    return rounded(dp.rolling_pair_corr(r, pair_list(r)))


PF = "OVER (PARTITION BY asset_i, asset_j ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def pair_frame(n: int) -> str:
    return PF.format(n - 1)


RP = {"pr": "SELECT a.symbol AS asset_i, b.symbol AS asset_j, a.ts, a.ret AS x, b.ret AS y FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol"}
ROLLC = ("CASE WHEN count(x) {f} = {n} AND var_pop(x) {f} > 1e-18 AND var_pop(y) {f} > 1e-18 THEN corr(x, y) {f} END")
register("D17_rolling_pair_corr", _rolling, ctes(
    f"SELECT asset_i, asset_j, ts, {tidy(ROLLC.format(f=pair_frame(30), n=30))} AS correlation FROM pr", **NAT, **RP))

register("F9_window_corr", lambda spark, d: rounded(dp.window_corr(dp.returns_matrix(nations(spark, d)))), ctes(
    " UNION ALL ".join(
        f"SELECT CAST({w} AS INTEGER) AS \"window\", a.symbol AS asset_i, b.symbol AS asset_j, {tidy('CASE WHEN var_pop(a.ret) > 1e-18 AND var_pop(b.ret) > 1e-18 THEN corr(a.ret, b.ret) END')} AS corr "
        f"FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ts IN (SELECT ts FROM (SELECT DISTINCT ts FROM r) ORDER BY ts DESC LIMIT {w}) "
        f"AND (SELECT count(DISTINCT ts) FROM r) >= {w} GROUP BY a.symbol, b.symbol" for w in (30, 60, 90)), **NAT))


def avg_corr(n: int, name: str) -> str:
    c = ROLLC.format(f=pair_frame(n), n=n)
    return (f"SELECT ts, avg(c) AS {name} FROM (SELECT ts, {c} AS c FROM pr) GROUP BY ts HAVING count(c) > 0")


register("F10_avg_pairwise_corr", lambda spark, d: rounded(dp.avg_pairwise_corr(dp.returns_matrix(segments(spark, d)), 60)), ctes(
    f"SELECT ts, {rnd('avg_corr')} FROM ({avg_corr(60, 'avg_corr')})", **SEG, **RP))
register("F11_corr_breakdown", lambda spark, d: rounded(dp.corr_breakdown(dp.returns_matrix(segments(spark, d)))), ctes(
    f"SELECT ts, {rnd('short_corr long_corr')}, {flag('long_corr - short_corr > 0.3')} AS breakdown FROM ({avg_corr(30, 'short_corr')}) "
    f"LEFT JOIN ({avg_corr(90, 'long_corr')}) USING (ts)", **SEG, **RP))
DAYF = "OVER (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
register("F12_diversification_ratio", lambda spark, d: rounded(dp.diversification_ratio(dp.returns_matrix(nations(spark, d)))), ctes(
    f"""SELECT ts, {tidy('coalesce(v / nullif(ps, 0), 1)')} AS diversification_ratio FROM (
    SELECT ts, v, CASE WHEN count(p) {DAYF} = 60 THEN stddev_samp(p) {DAYF} END AS ps FROM (
    SELECT ts, avg(ret) AS p, avg(s) AS v FROM (SELECT *, CASE WHEN count(ret) {frame(60)} = 60 THEN stddev_samp(ret) {frame(60)} END AS s FROM r)
    GROUP BY ts)) WHERE ps IS NOT NULL""", **NAT))
register("F12_diversification_static", lambda spark, d: rounded(dp.diversification_static(dp.returns_matrix(nations(spark, d)))), ctes(
    f"SELECT {tidy('(SELECT avg(s) FROM (SELECT stddev_samp(ret) AS s FROM r GROUP BY symbol)) / (SELECT stddev_samp(p) FROM (SELECT avg(ret) AS p FROM r GROUP BY ts))')} AS diversification_ratio",
    **NAT))
register("F16_coint_scan", lambda spark, d: rounded(ur.coint_scan(nations(spark, d))))
register("F17_spread_analysis", lambda spark, d: rounded(dp.spread_analysis(
    nations(spark, d), pair_list(nations(spark, d)))), ctes(
    f"""SELECT asset_i, asset_j, ts, {rnd('ratio spread_mean spread_std z_score')}, {flag('z_score < -2')} AS long_signal,
    {flag('z_score > 2')} AS short_signal, {flag('abs(z_score) < 0.5')} AS exit_signal FROM (
    SELECT *, (ratio - spread_mean) / nullif(spread_std, 0) AS z_score FROM (
    SELECT *, CASE WHEN count(ratio) {pair_frame(60)} = 60 THEN avg(ratio) {pair_frame(60)} END AS spread_mean,
    CASE WHEN count(ratio) {pair_frame(60)} = 60 THEN stddev_samp(ratio) {pair_frame(60)} END AS spread_std FROM (
    SELECT a.symbol AS asset_i, b.symbol AS asset_j, a.ts, a.close / nullif(b.close, 0) AS ratio FROM bars a JOIN bars b
    ON a.ts = b.ts AND a.symbol < b.symbol)))""", bars=panel(NATION)))
# tidied where they are made: a decimal number for each of so many pairs costs more than the pair
register("F19_pair_corr_static", lambda spark, d: dp.pair_corr_static(cl.panel(supplier_bars(spark, d)), digits=6), ctes(
    f"SELECT a.symbol AS asset_i, b.symbol AS asset_j, count(*) AS n, {tidy('corr(a.close, b.close)')} AS corr "
    "FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol", bars=panel(SUPPLIER)))


def _corr_table(spark, d):
    p = nations(spark, d)
    price = dp.pair_corr_static(p).select("asset_i", "asset_j", "corr").withColumnRenamed("corr", "price_corr")
    ret = dp.pair_corr_static(dp.returns_matrix(p), "ret").select("asset_i", "asset_j", "corr").withColumnRenamed("corr", "return_corr")
    return rounded(price.join(ret, ["asset_i", "asset_j"]))


register("T3_corr_table", _corr_table, ctes(
    f"SELECT asset_i, asset_j, {rnd('price_corr return_corr')} FROM (SELECT a.symbol AS asset_i, b.symbol AS asset_j, corr(a.close, b.close) AS price_corr "
    "FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol) JOIN "
    f"(SELECT a.symbol AS asset_i, b.symbol AS asset_j, corr(a.ret, b.ret) AS return_corr {PAIRS.format('<')}) USING (asset_i, asset_j)", **NAT))
register("T10_top_corr_assets", lambda spark, d: rounded(dp.top_corr_assets(
    dp.corr_matrix(dp.returns_matrix(nations(spark, d))))), ctes(
    f"""SELECT a.symbol AS asset_i, b.symbol AS asset_j, {tidy('corr(a.ret, b.ret)')} AS corr FROM r a JOIN r b ON a.ts = b.ts AND a.symbol <= b.symbol
    WHERE a.symbol IN (SELECT symbol FROM best) AND b.symbol IN (SELECT symbol FROM best) GROUP BY a.symbol, b.symbol""",
    **NAT, **CM, best="SELECT symbol FROM (SELECT asset_i AS symbol, corr FROM cm UNION ALL SELECT asset_j, corr FROM cm) GROUP BY symbol "
                      "ORDER BY avg(abs(corr)) DESC, symbol LIMIT 50"))
