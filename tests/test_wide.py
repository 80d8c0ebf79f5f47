"""The wide table of indicators, made in one pass, against the operators that it is put together from."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from toys import BARS, bars, walk

from candlewick.functions import segments as sg
from candlewick.functions.guards import tidy
from candlewick.functions.rounding import half_up, tidied
from candlewick.operators import indicators as ind
from candlewick.operators import wide


def one_by_one(b):
    out = ind.keltner(ind.adx(ind.atr(ind.macd(ind.ema(ind.sma(b))))))
    out = ind.volume_roc(ind.roc(ind.williams_r(ind.stochastic(ind.rsi(out)))))
    out = ind.volume_ratio(ind.ad_line(ind.obv(ind.vwap(ind.vol_cone(ind.bollinger(out))))))
    return ind.volume_flags(ind.volatility_flags(ind.momentum_flags(ind.trend_flags(out))))


def rows_of(df):
    names = ["symbol", "ts", *wide.FIGURES, *wide.FLAGS]
    return df.select(names).toPandas().sort_values(["symbol", "ts"], na_position="first").reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark):
    """Long, short, flat and one-row series, a series without a symbol, and single values of every column missing."""
    r, rows = random.Random(3), []
    for symbol, n in (("A", 420), ("B", 231), ("C", 19), ("D", 1), (None, 60), ("F", 90), ("G", 205)):
        closes = [50.0] * n if symbol == "F" else walk(n, n)
        for i, c in enumerate(closes):
            s = 0.0 if symbol == "F" else r.random()
            row = [c, c + s, c - s, c, float(r.randint(0, 9)), c]
            if symbol in ("B", None):
                row = [None if r.random() < 0.02 else x for x in row]
            rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), *row))
    r.shuffle(rows)
    return spark.createDataFrame(rows, BARS).cache()


def test_one_pass_equals_the_single_operators(odd):
    got, want = rows_of(ind.all_indicators(odd)), rows_of(one_by_one(odd))
    # of a flat series the last bits of a power tell which mean is larger
    for name, a, b in (("ema_up", "ema_12", "ema_26"), ("macd_up", "macd", "macd_signal")):
        for x in (got, want):
            x[name] = x[name].where((want[a] - want[b]).abs() > 1e-9, 0)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)
    assert want[list(wide.FIGURES)].notna().any().all()


def test_moving_figures_take_no_window_of_their_own(odd):
    """The rows are sorted once and numbered; a window of Spark for each family added up its frame again at every row."""
    plan = ind.all_indicators(odd)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1


def test_series_that_go_on_over_many_batches(spark, odd):
    want = rows_of(ind.all_indicators(odd))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = rows_of(ind.all_indicators(odd))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(got, want)


def test_segments_and_other_columns(spark):
    b = bars(spark, {"A": walk(950, 1), "B": walk(37, 3)}, spread=0.5).withColumn("close", F.col("close").cast("decimal(20,8)"))
    op = lambda x: ind.all_indicators(x, ("sma_200", "bb_squeeze"))
    cut, whole = sg.in_segments(b, op, 220, 400), op(b)
    assert whole.columns == [*b.columns, "sma_200", "bb_squeeze"] and dict(whole.dtypes)["close"] == "decimal(20,8)"
    bare = ind.all_indicators(b, ("sma_200", "bb_squeeze"), keep=("symbol", "ts"))
    assert bare.columns == ["symbol", "ts", "sma_200", "bb_squeeze"]
    assert sorted(map(str, bare.collect())) == sorted(map(str, whole.select(bare.columns).collect()))
    a, b = (x.select("symbol", "ts", "sma_200", "bb_squeeze").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (cut, whole))
    pd.testing.assert_frame_equal(a, b)


def test_rounding_equals_that_of_spark(spark):
    r = random.Random(5)
    x = [0.0, -0.0, 0.5, -0.5, 4.999e-7, 5e-7, -5e-7, 4.99e-7, 1.0000005, -2.0000015, 1e-300, 123456789.1234565, 3e8 + 0.1234565, 1e15 + 0.5, 1e22, 1.7e308, float("inf")]
    x += [r.uniform(-1, 1) * 10.0 ** r.randint(-9, 12) for _ in range(3000)] + [(2 * r.randint(-10**7, 10**7) + 1) / 2e6 - 1e-9 for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    want = df.orderBy("i").select(tidy("x").alias("t"), F.round("x", 12).alias("r")).toPandas()
    assert tidied(np.array(x)).tolist() == want["t"].tolist()
    assert half_up(np.array(x), 12).tolist() == want["r"].tolist()
