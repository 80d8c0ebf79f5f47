import math
import random

import numpy as np
import pytest
from toys import bars, walk

from candlewick.operators import pairs as pt
from candlewick.operators import unitroot as ur


def slow_adf(x, constant=True):
    """Plain least squares for every lag order, then the refit on the longer sample."""
    x = np.asarray(x, float)
    dx = np.diff(x)
    longest = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - int(constant) - 1)

    def design(lags):
        rows, y = [], []
        for t in range(lags, len(dx)):
            rows.append(([1.0] if constant else []) + [x[t]] + [dx[t - k] for k in range(1, lags + 1)])
            y.append(dx[t])
        return np.array(rows), np.array(y)

    wide, y = design(longest)
    best = None
    for lags in range(longest + 1):
        m = wide[:, :wide.shape[1] - longest + lags]
        ssr = float(np.sum((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2))
        aic = len(y) * math.log(ssr / len(y)) + 2 * m.shape[1]
        if best is None or aic < best[0] - 1e-9:
            best = (aic, lags)
    m, y = design(best[1])
    coef = np.linalg.lstsq(m, y, rcond=None)[0]
    s2 = np.sum((y - m @ coef) ** 2) / (len(y) - m.shape[1])
    k = int(constant)
    return coef[k] / math.sqrt(s2 * np.linalg.inv(m.T @ m)[k, k]), best[1]


@pytest.mark.parametrize("seed,constant", [(1, True), (2, True), (3, False), (4, True)])
def test_adf_matches_brute_force(seed, constant):
    x = walk(300, seed)
    stat, lags, _ = ur.adf(np.array(x), constant)
    want, want_lags = slow_adf(x, constant)
    assert lags == want_lags and stat == pytest.approx(want, rel=1e-6)


def test_p_values_at_known_points():
    assert ur.p_value(-2.8615, 1) == pytest.approx(0.05, abs=0.001)
    assert ur.p_value(-3.3377, 2) == pytest.approx(0.05, abs=0.001)
    assert ur.p_value(-1.61001, 1) == pytest.approx(ur.p_value(-1.60999, 1), abs=0.005)


def test_scan_finds_the_planted_pair(spark):
    r = random.Random(5)
    a = walk(400, 7, 200.0)
    data = {"A": a, "B": [2 * v + r.gauss(0, 1) for v in a], "C": walk(400, 8, 200.0)}
    df = bars(spark, data)
    rows = {(x["asset_i"], x["asset_j"]): x for x in ur.coint_scan(df, blocks=2).collect()}
    assert len(rows) == 6 and rows["A", "B"]["cointegrated"] and rows["B", "A"]["cointegrated"]
    stat = {r["symbol"]: r for r in ur.adf_table(df).collect()}
    assert stat["A"]["stat"] == pytest.approx(slow_adf(a)[0], rel=1e-6)
    tests = pt.candidate_tests(df, level=0.0001, blocks=2)
    assert ("A", "B") in {tuple(r) for r in pt.common_pairs(tests).collect()}


def test_positions_match_the_state_machine(spark):
    import datetime as dt
    r = random.Random(11)
    z, v = [], 0.0
    for _ in range(2000):
        v = 0.8 * v + r.gauss(0, 0.7)
        z.append(v)
    rows = [("A", "B", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(z)]
    got = pt.positions(spark.createDataFrame(rows, "asset_i string, asset_j string, ts timestamp_ntz, zscore double")).orderBy("ts").collect()
    down = up = 0
    for i, row in enumerate(got):
        if i:
            if z[i - 1] > -1 and z[i] < -1:
                down = -1
            if down == -1 and z[i - 1] < 0 < z[i]:
                down = 0
            if z[i - 1] < 1 < z[i]:
                up = 1
            if up == 1 and z[i - 1] > 0 > z[i]:
                up = 0
        assert (row["down"], row["up"]) == (down, up)
