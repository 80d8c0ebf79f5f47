"""Operators whose bars are read once: what is left of the input in the plan of their result, and results by hand."""

import datetime as dt

from candlewick.operators import cleaning as cl
from candlewick.operators import learning as ml
from candlewick.operators import scoring as sc
from candlewick.operators import signals as sg
from candlewick.operators import tiers as tr
from toys import bars, walk


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some(spark):
    return bars(spark, {s: walk(200, k) for k, s in enumerate("ABC")}, spread=1.0)


def test_resample_keeps_a_symbol_together(spark):
    """No join with a calendar; empty bins in between, a symbol of one bar, a null symbol without values."""
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("A", day(1), 1.0), ("A", day(4), 2.0), ("B", day(2), 3.0), (None, day(1), 4.0), (None, day(3), 5.0)]
    df = spark.createDataFrame([(s, t, x, x, x, x, x, x) for s, t, x in rows], "symbol string, ts timestamp_ntz, open double, high double, "
                               "low double, close double, volume double, quote_volume double")
    out = cl.resample(df, "day")
    assert "Join" not in plan(out)
    got = sorted(((r["symbol"], r["ts"].day, r["close"], r["volume"]) for r in out.collect()), key=str)
    want = [("A", 1, 1.0, 1.0), ("A", 2, None, 0.0), ("A", 3, None, 0.0), ("A", 4, 2.0, 2.0), ("B", 2, 3.0, 3.0),
            *[(None, n, None, 0.0) for n in (1, 2, 3)]]
    assert got == sorted(want, key=str)


def test_scores_read_bars_once(spark):
    df = some(spark)
    out = sc.composite(df, "A")
    assert "LogicalRDD" not in plan(out)
    whole = {r["symbol"]: r for r in sc.factors(df).collect()}
    cycle = {r["symbol"]: r["market_cycle"] for r in sc.cycle_score(df, "A").collect()}
    apart = {r["symbol"]: r["correlation_dynamics"] for r in sc.correlation_score(df).collect()}
    rows = out.collect()
    assert len(rows) == 3
    for r in rows:
        assert all(abs(r[n] - whole[r["symbol"]][n]) < 1e-9 for n in sc.LOCAL)
        assert abs(r["market_cycle"] - cycle[r["symbol"]]) < 1e-9 and abs(r["correlation_dynamics"] - apart[r["symbol"]]) < 1e-9


def test_signal_features_read_bars_once(spark):
    out = sg.features(some(spark), "A", 15)
    assert "LogicalRDD" not in plan(out)
    closes = walk(200, 1)
    row = out.filter("symbol = 'B'").first()
    up = [closes[k] > closes[k - 1] for k in range(200)][-63:]
    assert row["n"] == 200 and abs(row["up63"] - sum(up) / 63) < 1e-12 and abs(row["sma"] - sum(closes[-20:]) / 20) < 1e-9


def test_tier_limits_keep_what_they_read_twice(spark):
    caps = spark.createDataFrame([("A", 60e6, 2e5), ("B", 60e6, 3e5)], "symbol string, market_cap_usd double, daily_volume_brl double")
    assert "InMemoryRelation" in plan(tr.apply_limits(tr.classify(tr.asset_metrics(some(spark), caps))))


def test_newest_volume_is_no_frame_at_every_row(spark):
    df = bars(spark, {"A": walk(40), "B": walk(20)}, {"A": range(1, 41), "B": range(1, 21)})
    stats = tr._tail_stats(df)
    assert "BETWEEN -29" not in plan(stats).upper() and "specifiedwindowframe(RowFrame, -29".upper() not in plan(stats).upper()
    got = {r["symbol"]: r["l"] for r in stats.collect()}
    assert got["A"]["_v30"] == sum(range(11, 41)) / 30 and abs(got["A"]["_s30"] - 77.5 ** 0.5) < 1e-9
    assert got["B"]["_v30"] is None and got["B"]["close"] == walk(20)[-1]


def test_labels_need_no_join(spark):
    """Against pairs of turns by hand, an open trade at the end included."""
    closes = walk(120, 5)
    out = ml.label_winning_trades(bars(spark, {"A": closes}))
    assert "Join" not in plan(out)
    rows = out.orderBy("ts").collect()
    want, entry = ["stop"] * len(rows), None
    for k, r in enumerate(rows):
        if r["turn"] == 1:
            entry = k
        elif r["turn"] == -1:
            if closes[k] >= closes[entry]:
                want[entry:k] = ["buy"] * (k - entry)
            entry = None
    assert "buy" in want and [r["label"] for r in rows] == want


def test_fits_read_a_stored_split(spark):
    split = ml.time_split(ml.feature_frame(ml.label_winning_trades(some(spark))))
    for how in ({"model": "tree"}, {"model": "forest", "trees": 3}):
        out = ml.classify(split, **how)
        assert "LogicalRDD" not in plan(out) and out.count() == split.filter("part = 'test'").count()
    assert "InMemoryRelation" in plan(ml.classification_metrics(out))


def test_recent_covariance_makes_listed_bars_only(spark, sf, monkeypatch):
    """The listed symbols are picked below the first aggregate, so before any shuffle of ticks."""
    from candlewick.plans import allocation

    got = []
    monkeypatch.setattr(allocation, "weights_of", lambda s, d: s.createDataFrame([("1", 0.5), ("2", 0.5)], "symbol string, weight double"))
    monkeypatch.setattr(allocation.pf, "recent_covariance", lambda b, listed: got.append(b) or listed.selectExpr("1.0 AS cov"))
    allocation._recent(spark, sf)
    text = plan(got[0])
    assert "LeftSemi" in text and text.index("LeftSemi") > text.rindex("Aggregate")
    assert {r["symbol"] for r in got[0].select("symbol").distinct().collect()} == {"1", "2"}
