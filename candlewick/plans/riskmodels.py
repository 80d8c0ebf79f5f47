"""U2 and U4 to U10: baskets, risk models and constrained portfolios over the nation panel, one universe a region and one of all; stops over supplier bars.

Fits, trees and solvers have no SQL twin and are held against brute force in tests; stops and the stress suite have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.functions.windows import over
from candlewick.operators import constrained, dependence as dp, garch, hierarchy, indicators, johansen, riskbudget, stops, stress, views
from candlewick.operators.shrinkage import shrunk_covariance
from candlewick.plans.dependence import NAT, nations
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, ctes, lag, rnd, roll, tidy
from candlewick.sources.market import supplier_bars, table


def regions(spark, d) -> DataFrame:
    """(universe, symbol): the nations of each region."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("universe"), F.col("n_nationkey").cast("string").alias("symbol"))


def universes(spark, d) -> DataFrame:
    """The regions, and all nations as one more."""
    own = regions(spark, d)
    return own.unionByName(own.select(F.lit("ALL").alias("universe"), "symbol"))


def covariances(spark, d) -> DataFrame:
    """Shrunk annual covariance of each universe, cut from that of all nations."""
    cov = shrunk_covariance(dp.returns_matrix(nations(spark, d)))
    listed = universes(spark, d)
    return listed.withColumnRenamed("symbol", "asset_i").join(cov, "asset_i").join(listed.withColumnRenamed("symbol", "asset_j"), ["universe", "asset_j"]).select(
        "universe", "asset_i", "asset_j", "cov")


def market_weights(spark, d) -> DataFrame:
    """(universe, symbol, weight): shares of volume."""
    size = nations(spark, d).groupBy("symbol").agg(F.sum("volume").alias("v")).join(universes(spark, d), "symbol")
    return size.select("universe", "symbol", (F.col("v") / F.sum("v").over(Window.partitionBy("universe"))).alias("weight"))


def mean_returns(spark, d) -> DataFrame:
    """(universe, symbol, mu): annual mean returns."""
    mu = dp.returns_matrix(nations(spark, d)).groupBy("symbol").agg((F.avg("ret") * 252).alias("mu"))
    return mu.join(universes(spark, d), "symbol").select("universe", "symbol", "mu")


def extreme_views(mu: DataFrame) -> DataFrame:
    """Two views a universe: its best asset goes on as it did, not quite surely; its best beats its worst by half of the difference, surely."""
    by = Window.partitionBy("universe")
    ends = mu.withColumns({"high": F.max(F.struct("mu", "symbol")).over(by), "low": F.min(F.struct("mu", "symbol")).over(by)})
    best, worst = F.col("symbol") == F.col("high.symbol"), F.col("symbol") == F.col("low.symbol")
    row = lambda view, share, outlook, doubt: F.struct(F.lit(view).alias("view"), share.alias("share"), outlook.alias("outlook"), F.lit(doubt).alias("doubt"))
    each = F.array(row("best", F.when(best, 1.0), F.col("high.mu"), 0.1), row("spread", F.when(best, 1.0).when(worst, -1.0), (F.col("high.mu") - F.col("low.mu")) / 2, 0.0))
    return ends.select("universe", "symbol", F.inline(each)).filter("share is not null").select("universe", "view", "symbol", "share", "outlook", "doubt")


def _posterior(spark, d) -> DataFrame:
    cov = covariances(spark, d)
    return views.posterior_returns(views.implied_returns(market_weights(spark, d), cov), cov, extreme_views(mean_returns(spark, d)))


def yearly_shares(spark, d) -> DataFrame:
    """(universe, day, symbol, weight): shares of each year's volume, on the first of the next year; a nation without bars in a year has none."""
    year = nations(spark, d).withColumn("day", F.add_months(F.date_trunc("year", "ts").cast("date"), 12).cast("timestamp_ntz"))
    size = year.groupBy("symbol", "day").agg(F.sum("volume").alias("v")).join(universes(spark, d), "symbol")
    whole = F.sum("v").over(Window.partitionBy("universe", "day"))
    return size.withColumn("total", whole).filter("total > 0").select("universe", "day", "symbol", (F.col("v") / F.col("total")).alias("weight"))


def _bounded(spark, d) -> DataFrame:
    return constrained.bounded_weights(yearly_shares(spark, d), mean_returns(spark, d), covariances(spark, d), low=0.0, high=0.3, turnover=0.2)


def _garch(spark, d) -> DataFrame:
    bars = supplier_bars(spark, d)
    return garch.garch(bars.select("symbol", "ts", over(bars).change("close").alias("ret")))


register("U2_johansen", lambda spark, d: rounded(johansen.johansen(nations(spark, d), regions(spark, d).withColumnRenamed("universe", "basket"))))
register("U4_hierarchical_parity", lambda spark, d: rounded(hierarchy.parity_weights(covariances(spark, d))))
register("U5_garch_forecast", lambda spark, d: rounded(_garch(spark, d)))
register("U6_black_litterman", lambda spark, d: rounded(_posterior(spark, d)))
register("U7_equal_risk", lambda spark, d: rounded(riskbudget.equal_risk_weights(covariances(spark, d))))
register("U8_bounded_weights", lambda spark, d: rounded(_bounded(spark, d)))


def _stops(spark, d) -> DataFrame:
    """Entries where the close comes back above the lower band."""
    bars = indicators.bollinger(indicators.atr(supplier_bars(spark, d)))
    s = over(bars)
    back = (F.col("close") > F.col("bb_lower")) & (s.lag("close") <= s.lag("bb_lower"))
    marked = bars.select("symbol", "ts", F.coalesce(back, F.lit(False)).alias("entry"), "low", "close", F.col("atr_14").alias("atr"))
    return stops.atr_stops(marked, distance=2.0).select("symbol", "ts", "entry", "position", "stop", "exit")


STOPS = {"pc": f"SELECT *, {lag('close')} AS pc FROM bars",
         "tr": "SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range FROM pc",
         "bb": f"SELECT *, {roll('avg', 'true_range', 14)} AS atr, {roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)} AS lo FROM tr",
         "en": f"""SELECT symbol, ts, low, close, atr, coalesce(close > lo AND {lag('close')} <= {lag('lo')}, false) AS entry,
             row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bb""",
         "st": """SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS ts, false AS entry, CAST(NULL AS DOUBLE) AS stop, 0 AS exit FROM (SELECT DISTINCT symbol FROM en)
             UNION ALL SELECT e.symbol, e.n, e.ts, e.entry,
             CASE WHEN s.stop IS NOT NULL AND e.low < s.stop THEN NULL WHEN s.stop IS NULL THEN CASE WHEN e.entry THEN e.close - 2 * e.atr END
                  ELSE greatest(s.stop, coalesce(e.close - 2 * e.atr, s.stop)) END,
             CASE WHEN s.stop IS NOT NULL AND e.low < s.stop THEN 1 ELSE 0 END FROM st s JOIN en e ON e.symbol = s.symbol AND e.n = s.n + 1"""}
register("U9_atr_stops", lambda spark, d: rounded(_stops(spark, d)), ctes(
    f"SELECT symbol, ts, entry, CASE WHEN stop IS NULL THEN 0 ELSE 1 END AS position, {rnd('stop')}, exit FROM st WHERE n > 0", bars=SUPPLIER, **STOPS))


def _stress(spark, d) -> DataFrame:
    """Each universe's volume weights as a portfolio; exposures are betas to the mean return of all nations."""
    r = dp.returns_matrix(nations(spark, d))
    day = r.groupBy("ts").agg(F.avg("ret").alias("m"))
    beta = r.join(day, "ts").groupBy("symbol").agg((F.covar_samp("ret", "m") / F.var_samp("m")).alias("beta"))
    held = market_weights(spark, d).withColumnRenamed("universe", "portfolio")
    return stress.stress(held, dp.cov_matrix(r), beta, stress.suite(spark))


STRESS = {**NAT, "uni": """SELECT r_name AS universe, CAST(n_nationkey AS VARCHAR) AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey
              UNION ALL SELECT 'ALL', CAST(n_nationkey AS VARCHAR) FROM nation""",
          "w": "SELECT universe AS portfolio, symbol, v / sum(v) OVER (PARTITION BY universe) AS weight FROM (SELECT symbol, sum(volume) AS v FROM bars GROUP BY symbol) JOIN uni USING (symbol)",
          "cov": "SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) * 252 AS c FROM r a JOIN r b ON a.ts = b.ts GROUP BY a.symbol, b.symbol HAVING count(*) > 30",
          "bt": "SELECT symbol, covar_samp(ret, m) / var_samp(m) AS beta FROM r JOIN (SELECT ts, avg(ret) AS m FROM r GROUP BY ts) USING (ts) GROUP BY symbol",
          "fl": """SELECT portfolio, sum(weight * sqrt(c)) AS sv, sum(weight * weight * c) AS sq, sum(weight * coalesce(beta, 1)) AS beta
              FROM w JOIN cov ON i = symbol AND j = symbol LEFT JOIN bt USING (symbol) GROUP BY portfolio""",
          "vr": "SELECT a.portfolio, sum(a.weight * b.weight * c) AS variance FROM w a JOIN w b ON a.portfolio = b.portfolio JOIN cov ON i = a.symbol AND j = b.symbol GROUP BY a.portfolio",
          "sc": "SELECT * FROM (VALUES " + ", ".join(str(s) for s in stress.SUITE) + ") t(scenario, shock, volatility, level, force, liquidity)",
          "al": """SELECT portfolio, scenario, variance, liquidity, CAST(volatility * volatility * ((1 - force) * variance + force * ((1 - level) * sq + level * sv * sv)) AS DOUBLE) AS after,
              CAST(greatest(-shock * beta, 0) AS DOUBLE) AS loss FROM fl JOIN vr USING (portfolio), sc"""}
register("U10_stress_suite", lambda spark, d: rounded(_stress(spark, d)), ctes(
    f"""SELECT portfolio, scenario, {tidy('sqrt(variance)')} AS volatility_before, {tidy('sqrt(after)')} AS volatility_after, {tidy('after / variance')} AS variance_ratio,
    {tidy('loss')} AS shock_loss, {tidy('1.6448536269514722 * sqrt(variance)')} AS var_before, {tidy('1.6448536269514722 * sqrt(after) + loss')} AS var_after,
    {tidy('2.5 * sqrt(variance)')} AS drawdown_before, {tidy('least(2.5 * sqrt(after) + loss, 1)')} AS drawdown_after, {tidy('1 / liquidity')} AS days_to_sell FROM al""", **STRESS))
