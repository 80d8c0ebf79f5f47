"""The helpers that keep heavy symbols and all-pairs work out of single tasks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from toys import bars, column, walk

from candlewick.functions import segments as sg
from candlewick.functions.blocks import pair_corr, pair_list, pair_moments
from candlewick.functions.ranks import share_at_most
from candlewick.operators import execution as ex
from candlewick.operators import indicators as ind
from candlewick.operators.returns import rolling_volatility


@pytest.fixture(scope="module")
def heavy(spark):
    """One symbol far longer than the segment size, one at its edge, one short."""
    return bars(spark, {"A": walk(950, 1), "B": walk(200, 2), "C": walk(37, 3)}).cache()


def test_positions_are_exact(heavy):
    rows = sg.with_position(heavy, 200).select("symbol", "ts", "_pos").toPandas().sort_values(["symbol", "ts"])
    for _, g in rows.groupby("symbol"):
        assert g["_pos"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("op,cols,halo", [
    (lambda b: ind.bollinger(ind.sma(b, (20, 50))), ["sma_20", "sma_50", "bb_width", "bb_position"], 50),
    (lambda b: ind.rsi(b), ["rsi"], 15), (lambda b: rolling_volatility(b, (30,)), ["volatility_30"], 31)])
def test_segments_equal_whole_series(heavy, op, cols, halo):
    whole = op(heavy).select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    cut = sg.in_segments(heavy, op, halo, 200).select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut)


def test_no_segment_exceeds_its_size(heavy):
    sizes = sg.split(heavy, 50, 200).groupBy("symbol", sg.SEGMENT).count().toPandas()
    assert sizes["count"].max() <= 250 and len(sizes) >= 7


def test_running_totals_across_segments(heavy):
    got = sg.running_totals(heavy, {"cum": "volume"}, 200)
    assert column(got, "cum") == [10.0 * (i + 1) for i in range(950)]


def test_pair_moments_match_pandas(spark):
    rng = np.random.default_rng(0)
    data = {f"S{i:02d}": [None if rng.random() < 0.3 else float(v) for v in rng.normal(size=60)] for i in range(9)}
    df = bars(spark, data).select("symbol", "ts", "close")
    got = pair_moments(df, "close", blocks=3, chunk_days=17).select("asset_i", "asset_j", "n", pair_corr().alias("c")).collect()
    want = pd.DataFrame(data).astype(float)
    corr = want.corr()
    assert len(got) == 9 * 10 // 2
    for r in got:
        assert r["asset_i"] <= r["asset_j"]
        assert r["n"] == (want[r["asset_i"]].notna() & want[r["asset_j"]].notna()).sum()
        assert r["c"] == pytest.approx(corr.loc[r["asset_i"], r["asset_j"]], abs=1e-9)


def test_constant_series_has_null_correlation(spark):
    df = bars(spark, {"A": [5.0] * 20, "B": walk(20)})
    row = pair_moments(df, "close").filter("asset_i < asset_j").select(pair_corr().alias("c")).first()
    assert row["c"] is None


def test_pair_list_is_complete(spark):
    s = spark.createDataFrame([(f"S{i}",) for i in range(12)], "symbol string")
    half = {tuple(r) for r in pair_list(s, 3).collect()}
    both = [tuple(r) for r in pair_list(s, 3, ordered=True).collect()]
    assert len(half) == 66 and len(both) == len(set(both)) == 132


def test_share_at_most_with_ties_and_outliers(spark):
    values = [0.5] * 40 + [0.1, 0.2, 0.2, 0.9, -3.0, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").withColumn("v", F.col("v"))
    got = {r["id"]: r["share"] for r in share_at_most(df, "v", "share", buckets=8).collect()}
    for i, v in enumerate(values):
        assert got[i] == pytest.approx(sum(x <= v for x in values) / len(values))


def test_floored_positions_match_a_loop(spark):
    import datetime as dt
    import random
    r = random.Random(3)
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, r.choice(["buy", "sell"]), float(r.randint(1, 9)), float(r.randint(1, 50))) for i in range(200)]
    got = ex.position_rollup(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id long, side string, price double, value double")).first()
    q = v = 0.0
    for _, _, _, side, price, value in rows:
        sign = 1 if side == "buy" else -1
        q, v = max(0.0, q + sign * value / price), max(0.0, v + sign * value)
    assert math.isclose(got["quantity"], q, abs_tol=1e-9) and math.isclose(got["value"], v, abs_tol=1e-9) and got["fills"] == 200


def test_pairs_are_whole_in_their_task(spark):
    """Several tiles, blocks and stretches: one row a pair without a shuffle of pairs, the sums of assets agree with them."""
    from candlewick.functions.blocks import mean_abs_corr, pair_corrs
    rng = np.random.default_rng(1)
    data = {f"S{i:03d}": [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=40)] for i in range(300)}
    data |= {"FLAT": [3.0] * 40, "SHORT": [1.0, 2.0] + [None] * 38, "NONE": [None] * 40}
    df = bars(spark, data).select("symbol", "ts", "close")
    pairs = pair_corrs(df, "close", blocks=1)
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = pairs.toPandas()
    want = pd.DataFrame(data).astype(float).drop(columns="NONE")
    corr = want.corr(min_periods=1)
    assert (got["asset_i"] < got["asset_j"]).all() and not got.duplicated(["asset_i", "asset_j"]).any()
    seen = want.notna().astype(int)
    both = seen.T @ seen
    assert len(got) == (np.triu(both.to_numpy(), 1) > 0).sum()
    for r in got.itertuples():
        c = corr.loc[r.asset_i, r.asset_j]
        assert r.n == both.loc[r.asset_i, r.asset_j]
        if r.n > 2:
            assert (math.isnan(c) and math.isnan(r.corr)) or r.corr == pytest.approx(c, abs=1e-9)
    for blocks in (1, 3):
        means = {r["symbol"]: r["mean_abs_corr"] for r in mean_abs_corr(df, "close", 20, blocks).collect()}
        assert set(means) == set(data) and means["FLAT"] is means["SHORT"] is means["NONE"] is None
        strong = corr.where(both >= 20).loc["S007"].drop("S007").abs().mean()
        assert means["S007"] == pytest.approx(strong, abs=1e-9)


def test_rolling_figures_of_series(spark):
    """Equal values have no deviation at all, a null leaves its windows without a figure, and the plan holds no moving frames."""
    from candlewick.operators.returns import rolling_moments, rolling_sharpe
    prices = walk(30, 5)
    prices[12] = None
    df = bars(spark, {"A": walk(90, 4), "B": prices, "C": [2.0 ** i for i in range(20)], "D": [7.0]})
    for op, cols in ((lambda b: rolling_volatility(b, (5,)), ["volatility_5"]), (lambda b: rolling_sharpe(b, (5,)), ["sharpe_5"]),
                     (lambda b: rolling_moments(b, 5), ["skew_5", "kurt_5"])):
        made = op(df)
        assert "specifiedwindowframe(RowFrame, -4" not in made._jdf.queryExecution().executedPlan().toString()
        for name in "ABCD":
            x = np.log(pd.Series(column(df, "close", name), dtype=float)).diff()
            x[x.isna()] = np.nan
            r = x.rolling(5)
            want = {"volatility_5": r.std() * 252 ** 0.5, "sharpe_5": (r.mean() * 252 - 0.02) / (r.std() * 252 ** 0.5), "skew_5": r.skew(), "kurt_5": r.kurt()}
            for c in cols:
                got = column(made, c, name)
                if name == "C":  # growth is the same at every bar
                    assert all(v is None or (c == "volatility_5" and v == 0.0) for v in got)
                    continue
                assert len(got) == len(x)
                for g, w in zip(got, want[c]):
                    assert (g is None and math.isnan(w)) or g == pytest.approx(w, abs=1e-7)


def test_decayed_means_take_one_sort(spark):
    from candlewick.functions.decay import alpha_of, ewm_means
    prices = [None, None, *walk(1500, 9)]
    prices[700] = None
    df = bars(spark, {"A": prices, "B": walk(3, 2)})
    made = ewm_means(df, {"fast": ("close", alpha_of(span=9)), "slow": ("close", alpha_of(span=50))})
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    for name, span in (("fast", 9), ("slow", 50)):
        for symbol in "AB":
            x = pd.Series(column(df, "close", symbol), dtype=float)
            want = x.ewm(span=span, ignore_na=True).mean().where(x.notna())
            got = column(made, name, symbol)
            assert all((g is None and math.isnan(w)) or g == pytest.approx(w, rel=1e-12) for g, w in zip(got, want)) and len(got) == len(want)
