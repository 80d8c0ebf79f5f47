"""Pairs trading: sample split, pair selection, residual z-scores, positions, trades and results per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.blocks import pair_list
from candlewick.functions.guards import div
from candlewick.functions.windows import over
from candlewick.operators.dependence import _pair_series, pair_corr_static
from candlewick.operators.unitroot import adf_table, pair_tests

PAIR = ("asset_i", "asset_j")


def split_cut(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """One value: the first date after the leading share of the distinct dates (a list bounded by the calendar)."""
    dates = bars.agg(F.array_sort(F.collect_set("ts")).alias("d"))
    return dates.select(F.col("d")[F.floor(F.size("d") * share).cast("int")].alias("cut"))


def split_sample(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """Tag rows `in` before the cut and `out` from it on."""
    return bars.withColumn("sample", F.when(F.col("ts") < split_cut(bars, share).scalar(), "in").otherwise("out"))


def non_stationary(bars: DataFrame, level: float = 0.1) -> DataFrame:
    return adf_table(bars, level).filter("non_stationary").select("symbol")


def candidate_tests(bars: DataFrame, level: float = 0.1, blocks: int | None = None) -> DataFrame:
    """Both cointegration tests for all pairs of non-stationary assets."""
    return pair_tests(bars.join(non_stationary(bars, level), "symbol", "left_semi"), blocks=blocks)


def common_pairs(tests: DataFrame, level: float = 0.02, fallback: int = 10) -> DataFrame:
    """Pairs found by both tests; when there are none, the first few of the second test."""
    one = tests.filter(F.col("resid_p") < level).select(*PAIR)
    two = tests.filter(F.col("coint_p") < level).select(*PAIR)
    both = one.intersect(two)
    hits = both.agg(F.count(F.lit(1)))
    spare = two.orderBy(*PAIR).limit(fallback).filter(hits.scalar() == 0)
    return both.unionByName(spare)


def rank_pairs(bars: DataFrame, pairs: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Pairs with their price correlation, highest first."""
    corr = pair_corr_static(bars, "close", blocks)
    return (corr if pairs is None else corr.join(pairs, list(PAIR), "left_semi")).select(*PAIR, "corr").orderBy(F.desc_nulls_last("corr"), *PAIR)


def residual_zscore(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Residual of asset_j on asset_i without constant, standardised; one aggregate gives slope, mean and deviation."""
    both = _pair_series(bars, pairs, "close")
    c = F.col
    sums = both.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(c("x") * c("x")).alias("sxx"),
        F.sum(c("x") * c("y")).alias("sxy"), F.sum(c("y") * c("y")).alias("syy")).withColumn("beta", div("sxy", "sxx"))
    mean = (c("sy") - c("beta") * c("sx")) / c("n")
    square = c("syy") - 2 * c("beta") * c("sxy") + c("beta") * c("beta") * c("sxx")
    stats = sums.select(*PAIR, "beta", mean.alias("m"), F.sqrt(div(square - c("n") * mean * mean, c("n") - 1)).alias("s"))
    return both.join(stats, list(PAIR)).select(
        *PAIR, "ts", "x", "y", "beta", div(c("y") - c("beta") * c("x") - c("m"), "s").alias("zscore"))


def positions(z: DataFrame, threshold: float = 1.0) -> DataFrame:
    """`down` is -1 from a fall through -threshold until a rise through 0; `up` mirrors it with +1.

    Every row either opens, closes or keeps the state, so the state is the last event so far.
    """
    s = over(z, by=PAIR)
    cur, prev = F.col("zscore"), s.lag("zscore")
    down = F.when((prev > -threshold) & (cur < -threshold), -1).when((prev < 0) & (cur > 0), 0)
    up = F.when((prev < threshold) & (cur > threshold), 1).when((prev > 0) & (cur < 0), 0)
    out = z.withColumns({"_d": down, "_u": up})
    state = lambda e: F.coalesce(F.last(e, ignorenulls=True).over(s.running), F.lit(0))
    return out.withColumns({"down": state("_d"), "up": state("_u")}).drop("_d", "_u")


def pair_trades(pos: DataFrame) -> DataFrame:
    """Closed trades of both directions with the profit of each leg; the sign of beta decides the X leg."""
    parts = []
    for name, side in (("down", -1), ("up", 1)):
        s = over(pos, by=PAIR)
        turns = pos.withColumn("_t", s.diff(name)).filter(F.col("_t") != 0)
        w = over(turns, by=PAIR)
        closed = turns.withColumns({"entry_ts": w.lag("ts"), "_x": w.lag("x"), "_y": w.lag("y")}).filter(
            (F.signum("_t") == -side) & F.col("entry_ts").isNotNull())
        y = -side * (F.col("y") - F.col("_y"))
        x = side * F.when(F.col("beta") > 0, 1).otherwise(-1) * (F.col("x") - F.col("_x"))
        parts.append(closed.select(*PAIR, F.lit(name).alias("direction"), "entry_ts", F.col("ts").alias("exit_ts"), "beta",
                                   x.alias("x_profit"), y.alias("y_profit")))
    return parts[0].unionByName(parts[1])


def pair_performance(trades: DataFrame) -> DataFrame:
    """Profit per pair and direction with subtotals per direction and overall ('all')."""
    named = trades.withColumn("pair", F.concat_ws("/", *PAIR))
    profit = F.sum(F.col("y_profit") + F.col("beta") * F.col("x_profit")).alias("profit")
    return named.rollup("direction", "pair").agg(F.count(F.lit(1)).alias("trades"), profit).fillna("all", subset=["direction", "pair"])


def run(bars: DataFrame, pairs: DataFrame, threshold: float = 1.0) -> DataFrame:
    return pair_trades(positions(residual_zscore(bars, pairs), threshold))


def every_pair(bars: DataFrame, blocks: int = 4) -> DataFrame:
    return pair_list(bars, blocks)
