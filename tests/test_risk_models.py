"""Parity, risk models, constrained portfolios and stops, each against a plain twin."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions.asof import asof_join
from candlewick.operators import constrained, garch, hierarchy, johansen, parity, portfolio, riskbudget, shrinkage, stops, stress, views

START = dt.datetime(2024, 1, 1)


def hours(k):
    return START + dt.timedelta(hours=k)


def half(universe, c):
    names = [f"s{k:02d}" for k in range(len(c))]
    return [(universe, names[i], names[j], float(c[i, j])) for i in range(len(c)) for j in range(i, len(c))]


COV = "universe string, asset_i string, asset_j string, cov double"


def random_cov(rng, n):
    x = rng.normal(size=(200, n)) * rng.uniform(0.1, 0.5, n) + rng.normal(size=(200, 1)) * rng.uniform(-0.2, 0.4, n)
    return np.cov(x.T).reshape(n, n)


@pytest.mark.parametrize("rows", [1_000_000, 7])
def test_asof_join(spark, rows):
    r = random.Random(1)
    left = [(r.choice("AAAAB"), hours(r.randrange(400)), float(k)) for k in range(150)] + [(None, hours(1), 0.5), ("C", hours(3), 1.5), ("A", hours(5), 2.5), ("A", hours(5), 2.5)]
    right = [(r.choice("AAAAB"), hours(r.randrange(400)), float(k), None if k % 9 == 0 else str(k)) for k in range(120)]
    tolerance = 6 * 3600.0
    out = asof_join(spark.createDataFrame(left, "symbol string, ts timestamp_ntz, x double"), spark.createDataFrame(right, "symbol string, ts timestamp_ntz, v double, note string"),
                    tolerance, ["v", "note"], rows=rows).collect()
    want = []
    for s, t, x in left:
        near = [(rt, v, note) for rs, rt, v, note in right if rs == s and rt <= t and (t - rt).total_seconds() <= tolerance]
        best = max(near, key=lambda n: (n[0], n[1])) if near else (None, None, None)
        want.append((s, t, x, *best))
    order = lambda row: tuple(str(v) for v in row)
    assert sorted(map(tuple, out), key=order) == sorted(want, key=order) and any(w[3] for w in want)


def test_parity_gaps_and_breaches(spark):
    form = "symbol string, ts timestamp_ntz, close double"
    one = spark.createDataFrame([("A", hours(0), 100.0), ("A", hours(10), 100.0), ("A", hours(30), 100.0), ("B", hours(0), None)], form)
    other = spark.createDataFrame([("A", hours(0), 101.0), ("A", hours(9), 90.0), ("C", hours(1), 1.0)], form)
    out = {(r.symbol, r.side, r.ts): r for r in parity.price_parity(one, other, 7200.0, 0.05).collect()}
    assert len(out) == 6
    assert out["A", "one", hours(0)].breach == 0 and out["A", "one", hours(10)].breach == 1 and out["A", "one", hours(10)].age == 3600
    assert out["A", "one", hours(30)].gap == 1 and out["A", "one", hours(30)].deviation is None
    assert out["A", "other", hours(9)].gap == 1 and out["C", "other", hours(1)].gap == 1 and out["A", "other", hours(0)].gap == 0
    total = {(r.symbol, r.side): (r.bars, r.gaps, r.breaches) for r in parity.parity_summary(parity.price_parity(one, other, 7200.0, 0.05)).collect()}
    assert total == {("A", "one"): (3, 1, 1), ("A", "other"): (2, 1, 0), ("C", "other"): (1, 1, 0)}


def johansen_twin(x, lags):
    """By regressions on whole matrices."""
    d = np.diff(x, axis=0)
    y, level = d[lags:], x[lags:-1]
    z = np.column_stack([*[d[lags - k:-k] for k in range(1, lags + 1)], np.ones(len(y))])
    rest = lambda m: m - z @ np.linalg.lstsq(z, m, rcond=None)[0]
    r0, r1 = rest(y), rest(level)
    s00, s11, s01 = r0.T @ r0, r1.T @ r1, r0.T @ r1
    values = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01)).real)[::-1]
    return len(y), values, s11 / len(y)


@pytest.mark.parametrize("lags", [1, 2])
def test_johansen(spark, lags):
    rng, rows, baskets, want = np.random.default_rng(lags), [], [], {}
    for b in range(8):
        p, n = 2 + b % 5, 300
        walk = np.cumsum(rng.normal(size=(n, p)), axis=0)
        if b % 2:
            walk[:, 1] = 0.5 * walk[:, 0] + rng.normal(size=n)
        x = walk + 50_000
        for k in range(p):
            symbol = f"b{b}k{k}"
            baskets.append((f"b{b}", symbol))
            rows += [(symbol, hours(t), float(x[t, k])) for t in range(n)]
        want[f"b{b}"] = johansen_twin(x - x.mean(axis=0), lags)
    rows += [("flat", hours(t), 5.0) for t in range(300)] + [("b0k0", hours(900), 1.0)]
    baskets += [("odd", "flat"), ("odd", "b0k0"), ("thin", "b0k0"), ("thin", "missing")] + [("large", f"b{b}k0") for b in range(8)]
    prices = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").repartition(3)
    got = johansen.johansen(prices.filter("close <> 1"), spark.createDataFrame(baskets, "basket string, symbol string"), lags).collect()
    by = {b: sorted((r for r in got if r.basket == b), key=lambda r: r["rank"]) for b in {r.basket for r in got}}
    assert set(by) == {*want, "odd"} and by["odd"][0].trace is None
    for b, (n, values, level) in want.items():
        assert [r.n for r in by[b]] == [n] * len(values)
        assert np.allclose([r.eigenvalue for r in by[b]], values, rtol=1e-7, atol=1e-10)
        assert np.allclose([r.trace for r in by[b]], [-n * np.log(1 - values[k:]).sum() for k in range(len(values))], rtol=1e-6)
        v = np.array([r.vector for r in by[b]]).T
        assert np.allclose(v.T @ level @ v, np.eye(len(values)), atol=1e-6)
    tied = [by[f"b{b}"][0].rejected for b in (1, 3, 5, 7)]
    assert all(tied)


def test_shrinkage_is_the_closed_formula(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 9)) * rng.uniform(0.5, 2, 9) + 0.7 * rng.normal(size=(120, 1)) + 3.0
    rows = [(f"s{k}", hours(t), float(x[t, k])) for k in range(9) for t in range(120)] + [("s0", hours(500), 99.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    c = x - x.mean(axis=0)
    s = c.T @ c / 120
    target = np.trace(s) / 9
    apart = ((s - target * np.eye(9)) ** 2).sum()
    error = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 120 ** 2
    share = min(error, apart) / apart
    for blocks in (None, 3):
        one = shrinkage.shrinkage_intensity(df, blocks=blocks).first()
        assert (one.n, one.assets) == (120, 9) and np.isclose(one.target, target) and np.isclose(one.intensity, share) and 0 < share < 1
        got = {(r.asset_i, r.asset_j): r["cov"] for r in shrinkage.shrunk_covariance(df, year=1.0, blocks=blocks).collect()}
        want = (1 - share) * s + share * target * np.eye(9)
        assert len(got) == 45 and all(np.isclose(v, want[int(i[1]), int(j[1])]) for (i, j), v in got.items())


def parity_twin(c):
    n, sd = len(c), np.sqrt(np.diag(c))
    d = np.sqrt(np.maximum((1 - c / np.outer(sd, sd)) / 2, 0))
    clusters = [[k] for k in range(n)]
    while len(clusters) > 1:
        _, i, j = min((min(d[p, q] for p in a for q in b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        one, other = sorted((clusters[i], clusters[j]), key=min)
        clusters = [x for k, x in enumerate(clusters) if k not in (i, j)] + [one + other]
    weight, todo = np.ones(n), [clusters[0]]

    def variance(part):
        sub = c[np.ix_(part, part)]
        w = 1 / np.diag(sub)
        return w @ sub @ w / w.sum() ** 2

    while todo:
        part = todo.pop()
        if len(part) > 1:
            left, right = part[:len(part) // 2], part[len(part) // 2:]
            share = variance(right) / (variance(left) + variance(right))
            weight[left] *= share
            weight[right] *= 1 - share
            todo += [left, right]
    return clusters[0], weight


def test_hierarchical_parity(spark):
    rng, rows, want = np.random.default_rng(0), [], {}
    for u, n in (("a", 13), ("b", 6), ("c", 1), ("d", 2)):
        c = random_cov(rng, n)
        rows += half(u, c)
        order, weight = parity_twin(c)
        want.update({(u, f"s{k:02d}"): (order.index(k), weight[k]) for k in range(n)})
    got = {(r.universe, r.symbol): (r["at"], r.weight) for r in hierarchy.parity_weights(spark.createDataFrame([*rows, ("a", "still", "still", 0.0)], COV)).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


def likelihood(x, var, a, b):
    h, total = var, 0.0
    for v in x * x:
        total -= 0.5 * (np.log(h) + v / h)
        h = (1 - a - b) * var + a * v + b * h
    return total, h


def test_garch_recovers_and_segments_agree(spark):
    rng, rows, of = np.random.default_rng(0), [], {}
    for name, (a, b, n) in {"p": (0.1, 0.85, 8000), "q": (0.25, 0.5, 5000)}.items():
        h, x = 1.0, []
        for _ in range(n):
            x.append(rng.normal() * np.sqrt(h))
            h = (1 - a - b) + a * x[-1] ** 2 + b * h
        of[name] = np.array(x) * 0.01
        rows += [(name, hours(t), float(v)) for t, v in enumerate(of[name])]
    rows += [("still", hours(t), 0.0) for t in range(50)] + [("short", hours(t), float(t)) for t in range(5)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double").repartition(3)
    whole = {r.symbol: r for r in garch.garch(df).collect()}
    assert set(whole) == {"p", "q"}
    rough, cut = ({r.symbol: r for r in garch.garch(df, rows=k, rounds=2).collect()} for k in (1_000_000, 700))
    assert abs(whole["p"].alpha - 0.1) < 0.03 and abs(whole["p"].beta - 0.85) < 0.05 and abs(whole["q"].alpha - 0.25) < 0.06 and abs(whole["q"].beta - 0.5) < 0.1
    for name, row in whole.items():
        x = of[name] - of[name].mean()
        best, h = likelihood(x, (x * x).mean(), row.alpha, row.beta)
        assert np.isclose(row.log_likelihood, best) and np.isclose(row.forecast_variance, h)
        # no neighbour does better
        for da, db in ((0.004, 0), (-0.004, 0), (0, 0.004), (0, -0.004), (0.004, -0.004), (-0.004, 0.004)):
            assert likelihood(x, (x * x).mean(), row.alpha + da, row.beta + db)[0] < best + 1e-3
        assert all(np.isclose(cut[name][c], rough[name][c]) for c in ("alpha", "beta", "log_likelihood", "forecast_variance"))


def test_views(spark):
    rng, tau = np.random.default_rng(4), 0.05
    covs = {u: random_cov(rng, n) for u, n in (("a", 6), ("b", 4), ("c", 3))}
    cov = spark.createDataFrame([r for u, c in covs.items() for r in half(u, c)], COV)
    weights = {u: rng.dirichlet(np.ones(len(c))) for u, c in covs.items()}
    held = spark.createDataFrame([(u, f"s{k:02d}", float(w)) for u, ws in weights.items() for k, w in enumerate(ws)], "universe string, symbol string, weight double")
    prior = views.implied_returns(held, cov)
    stated = [("a", "sure", "s01", 1.0, 0.3, 0.0), ("a", "spread", "s02", 1.0, 0.1, 0.02), ("a", "spread", "s04", -1.0, 0.1, 0.02), ("b", "x", "s00", 0.5, 0.2, 0.01), ("b", "x", "s03", 0.5, 0.2, 0.01),
              ("c", "none", "unknown", 1.0, 9.0, 0.0)]
    out = views.posterior_returns(prior, cov, spark.createDataFrame(stated, "universe string, view string, symbol string, share double, outlook double, doubt double"), tau).collect()
    assert len(out) == 13
    for u, c in covs.items():
        first = 2.5 * c @ weights[u]
        names = sorted({v for x, v, *_ in stated if x == u and u != "c"})
        p, q, o = np.zeros((len(names), len(c))), np.zeros(len(names)), np.zeros(len(names))
        for x, v, s, share, outlook, doubt in stated:
            if x == u and v in names:
                p[names.index(v), int(s[1:])], q[names.index(v)], o[names.index(v)] = share, outlook, doubt
        want = first + (tau * c @ p.T @ np.linalg.solve(tau * p @ c @ p.T + np.diag(o), q - p @ first) if names else 0)
        got = {r.symbol: r for r in out if r.universe == u}
        assert np.allclose([got[f"s{k:02d}"].posterior for k in range(len(c))], want) and np.allclose([got[f"s{k:02d}"].prior for k in range(len(c))], first)
    assert np.isclose(next(r.posterior for r in out if (r.universe, r.symbol) == ("a", "s01")), 0.3)


def test_closed_form_over_several_universes(spark):
    rng = np.random.default_rng(10)
    covs = {f"u{k}": random_cov(rng, 2 + k) for k in range(6)}
    mu = {f"s{k:02d}": float(m) for k, m in enumerate(rng.normal(0.1, 0.05, 7))}
    cov = spark.createDataFrame([r for u, c in covs.items() for r in half(u, c)], COV)
    out = portfolio.closed_form(spark.createDataFrame(list(mu.items()), "symbol string, mu double"), cov, rate=0.02, universe="universe")
    rows = out.collect()
    for u, c in covs.items():
        mine = sorted((r for r in rows if r.universe == u), key=lambda r: r.symbol)
        low, top = np.array([r.min_variance for r in mine]), np.array([r.max_sharpe for r in mine])
        m = np.array([mu[r.symbol] for r in mine])
        assert len(mine) == len(c) and np.isclose(low.sum(), 1) and np.isclose(top.sum(), 1)
        # at the least variance all assets add the same to it; at the best ratio in proportion to their excess return
        assert np.ptp(c @ low) < 1e-9 and np.allclose(np.cross([*(c @ top)[:2], 0], [*(m - 0.02)[:2], 0]), 0, atol=1e-9)
        assert all(low @ c @ low <= w @ c @ w + 1e-12 for w in rng.dirichlet(np.ones(len(c)), 50))
    points = portfolio.efficient_frontier(out, 0.0, 0.3, 10).collect()
    least = {r.universe: 1 / np.sqrt(r.a) for r in rows}
    assert len(points) == 6 * 11 and all(p.risk >= least[p.universe] - 1e-12 for p in points)


def test_equal_risk_over_many_universes(spark):
    rng = np.random.default_rng(5)
    covs = {f"u{k}": random_cov(rng, 1 + k % 9) for k in range(9)}
    covs["tight"] = np.full((8, 8), 0.95) + 0.05 * np.eye(8)
    covs["against"] = np.array([[1.0, -0.9], [-0.9, 1.0]])
    out = riskbudget.equal_risk_weights(spark.createDataFrame([r for u, c in covs.items() for r in half(u, c)] + [("u3", "still", "still", 0.0)], COV)).collect()
    for u, c in covs.items():
        w = np.array([r.weight for r in sorted((r for r in out if r.universe == u), key=lambda r: r.symbol)])
        assert len(w) == len(c) and np.isclose(w.sum(), 1) and (w > 0).all()
        share = w * (c @ w) / (w @ c @ w)
        assert np.abs(share - 1 / len(c)).max() < 1e-6
    assert all(r.converged for r in out) and len(out) == sum(map(len, covs.values()))


def test_projection_is_nearest(spark):
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(2, 7))
        old, v, low, high = rng.dirichlet(np.ones(n)), rng.normal(size=n), np.zeros(n), np.full(n, 0.8)
        old = np.clip(old, 0, 0.8) / np.clip(old, 0, 0.8).sum()
        cap = float(rng.uniform(0.05, 1.2))
        if (old > 0.8).any():
            continue
        w = constrained.project(v, old, low, high, cap)
        assert abs(w.sum() - 1) < 1e-9 and (w >= -1e-12).all() and (w <= 0.8 + 1e-12).all() and np.abs(w - old).sum() <= cap + 1e-9
        # no allowed point on a straight way from it is nearer
        for _ in range(200):
            other = np.clip(rng.dirichlet(np.ones(n)), 0, 0.8)
            other /= other.sum()
            gap = np.abs(other - old).sum()
            if gap > cap:
                other = old + (other - old) * cap / gap
            if (other <= 0.8).all():
                assert ((w - v) ** 2).sum() <= ((other - v) ** 2).sum() + 1e-8


def test_bounded_weights(spark):
    rng, rows, old, mus = np.random.default_rng(7), [], [], []
    covs = {"a": random_cov(rng, 8), "b": random_cov(rng, 5)}
    mu = {u: rng.normal(0.1, 0.1, len(c)) for u, c in covs.items()}
    start = {}
    for u, c in covs.items():
        rows += half(u, c)
        mus += [(u, f"s{k:02d}", float(m)) for k, m in enumerate(mu[u])]
        for day in range(2):
            w = rng.dirichlet(np.full(len(c), 8.0))
            start[u, hours(day)] = w
            old += [(u, hours(day), f"s{k:02d}", float(x)) for k, x in enumerate(w)]
    old += [("none", hours(0), "x", 0.5), ("none", hours(0), "y", 0.5)]
    out = constrained.bounded_weights(spark.createDataFrame(old, "universe string, day timestamp_ntz, symbol string, weight double"),
                                      spark.createDataFrame(mus, "universe string, symbol string, mu double"), spark.createDataFrame(rows, COV), high=0.4, turnover=0.3).collect()
    for (u, day), w0 in start.items():
        mine = sorted((r for r in out if (r.universe, r.day) == (u, day)), key=lambda r: r.symbol)
        w = np.array([r.weight for r in mine])
        assert all(r.feasible for r in mine) and abs(w.sum() - 1) < 1e-8 and w.min() > -1e-9 and w.max() < 0.4 + 1e-9 and np.abs(w - w0).sum() < 0.3 + 1e-8
        value = lambda x: mu[u] @ x - 1.25 * x @ covs[u] @ x  # noqa: B023, E731
        assert np.isclose(mine[0].objective, value(w))
        for _ in range(2000):
            other = rng.dirichlet(np.ones(len(w0)))
            gap = np.abs(other - w0).sum()
            other = w0 + (other - w0) * min(1.0, 0.3 / gap)
            assert other.max() > 0.4 or value(other) <= value(w) + 1e-9
    assert [r.feasible for r in out if r.universe == "none"] == [False, False]


def test_stress(spark):
    rng = np.random.default_rng(8)
    c = random_cov(rng, 5)
    w = {"p": rng.dirichlet(np.ones(5)), "q": np.array([1.0, 0, 0, 0, 0])}
    weights = spark.createDataFrame([(p, f"s{k:02d}", float(x)) for p, ws in w.items() for k, x in enumerate(ws)], "portfolio string, symbol string, weight double")
    beta = spark.createDataFrame([(f"s{k:02d}", 0.5 * k) for k in range(4)], "symbol string, beta double")
    cov = spark.createDataFrame([r[1:] for r in half("", c)], "asset_i string, asset_j string, cov double")
    out = {(r.portfolio, r.scenario): r for r in stress.stress(weights, cov, beta, stress.suite(spark)).collect()}
    assert len(out) == 2 * len(stress.SUITE)
    sd = np.sqrt(np.diag(c))
    for name, shock, volatility, level, force, liquidity in stress.SUITE:
        forced = (1 - force) * c / np.outer(sd, sd) + force * np.where(np.eye(5) > 0, 1.0, level)
        assert np.linalg.eigvalsh(forced).min() > -1e-12
        for p, ws in w.items():
            after = volatility ** 2 * ws @ (forced * np.outer(sd, sd)) @ ws
            loss = -shock * (ws @ np.array([0, 0.5, 1.0, 1.5, 1.0]))
            row = out[p, name]
            assert np.isclose(row.volatility_after ** 2, after) and np.isclose(row.variance_ratio, after / (ws @ c @ ws)) and np.isclose(row.shock_loss, max(loss, 0))
            assert np.isclose(row.var_after, 1.6448536269514722 * np.sqrt(after) + max(loss, 0)) and np.isclose(row.days_to_sell, 1 / liquidity)


@pytest.mark.parametrize("trail", [True, False])
def test_stops_equal_a_loop_on_any_segments(spark, trail):
    rng, rows, want = np.random.default_rng(9), [], {}
    for s in range(5):
        n = int(rng.integers(1, 160))
        close = 100 + np.cumsum(rng.normal(size=n))
        low, atr, entry = close - rng.random(n) * 2, rng.random(n) + 0.2, rng.random(n) < 0.25
        for x in (low, close, atr):
            x[rng.random(n) < 0.05] = np.nan
        held, levels, exits, _ = stops.replay(entry, low, close, atr, 1.5, trail, None)
        number = lambda v: None if v != v else float(v)
        for t in range(n):
            rows.append((f"s{s}", hours(t), bool(entry[t]), number(low[t]), number(close[t]), number(atr[t])))
            want[f"s{s}", hours(t)] = (int(held[t]), number(levels[t]), int(exits[t]))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, entry boolean, low double, close double, atr double").repartition(3)
    for size in (1_000_000, 20, 3):
        assert {(r.symbol, r.ts): (r.position, r.stop, r.exit) for r in stops.atr_stops(df, 1.5, trail, rows=size).collect()} == want
    assert any(v[2] for v in want.values()) and stops.atr_stops(df.filter("false")).count() == 0


def test_stops_by_hand(spark):
    """In at 100 with a stop at 98, raised to 101, out below it, and in again later."""
    bars = [(True, 99.0, 100.0), (False, 99.5, 103.0), (False, 100.5, 101.0), (True, 100.2, 102.0), (True, 101.0, 104.0)]
    df = spark.createDataFrame([("A", hours(t), e, lo, c, 1.0) for t, (e, lo, c) in enumerate(bars)], "symbol string, ts timestamp_ntz, entry boolean, low double, close double, atr double")
    got = [(r.position, r.stop, r.exit) for r in stops.atr_stops(df, 2.0).orderBy("ts").collect()]
    assert got == [(1, 98.0, 0), (1, 101.0, 0), (0, None, 1), (1, 100.0, 0), (1, 102.0, 0)]


def test_forced_correlations_keep_the_diagonal(spark):
    corr = spark.createDataFrame([("a", "a", 1.0), ("a", "b", -0.5), ("b", "b", 1.0)], "asset_i string, asset_j string, corr double")
    got = {(r.asset_i, r.asset_j): round(r["corr"], 9) for r in stress.forced_correlations(corr, 0.9, 0.5).select("asset_i", "asset_j", F.col("corr")).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): 0.2, ("b", "b"): 1.0}
