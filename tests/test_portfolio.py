import numpy as np
import pytest
from toys import bars, walk

from candlewick.operators import backtest as bt
from candlewick.operators import dependence as dp
from candlewick.operators import portfolio as pf
from candlewick.operators import returns as rt


@pytest.fixture(scope="module")
def universe(spark):
    df = bars(spark, {f"S{i}": walk(200, i) for i in range(6)})
    r = dp.returns_matrix(df).cache()
    return df, r, pf.mean_returns(r).cache(), dp.cov_matrix(r).cache()


def dense(mu, cov):
    m = {r["symbol"]: r["mu"] for r in mu.collect()}
    names = sorted(m)
    c = np.zeros((len(names), len(names)))
    for r in cov.collect():
        i, j = names.index(r["asset_i"]), names.index(r["asset_j"])
        c[i, j] = c[j, i] = r["cov"]
    return names, np.array([m[n] for n in names]), c


def test_closed_form_weights(universe):
    _, _, mu, cov = universe
    names, m, c = dense(mu, cov)
    got = {r["symbol"]: r for r in pf.closed_form(mu, cov, 0.02).collect()}
    low = np.array([got[n]["min_variance"] for n in names])
    top = np.array([got[n]["max_sharpe"] for n in names])
    assert low.sum() == pytest.approx(1) and top.sum() == pytest.approx(1)
    assert np.ptp(c @ low) == pytest.approx(0, abs=1e-9)  # equal marginal risk
    ratio = (c @ top) / (m - 0.02)
    assert np.ptp(ratio) == pytest.approx(0, abs=1e-6 * abs(ratio).max())


def test_frontier_touches_the_minimum(universe):
    _, _, mu, cov = universe
    sol = pf.closed_form(mu, cov)
    names, _, c = dense(mu, cov)
    w = {r["symbol"]: r["min_variance"] for r in sol.collect()}
    v = np.array([w[n] for n in names])
    best = float(np.sqrt(v @ c @ v))
    risks = [r["risk"] for r in pf.efficient_frontier(sol, -2.0, 2.0, 400).collect()]
    assert min(risks) >= best - 1e-9 and min(risks) == pytest.approx(best, rel=1e-2)


def test_random_portfolios_are_portfolios(spark, universe):
    _, _, mu, cov = universe
    w = pf.random_weights(spark, mu, 50)
    for r in w.groupBy("id").agg({"weight": "sum"}).collect():
        assert r[1] == pytest.approx(1.0)
    names, m, c = dense(mu, cov)
    one = {r["symbol"]: r["weight"] for r in w.filter("id = 7").collect()}
    v = np.array([one[n] for n in names])
    got = pf.random_portfolios(spark, mu, cov, 50).filter("id = 7").first()
    assert got["ret"] == pytest.approx(v @ m) and got["volatility"] == pytest.approx(np.sqrt(v @ c @ v))


def test_risk_shares_sum_to_one(universe):
    _, _, mu, cov = universe
    shares = pf.risk_contribution(pf.equal_weights(mu), cov)
    assert sum(r["risk_share"] for r in shares.collect()) == pytest.approx(1.0)


def test_correlations_and_drawdowns_are_in_range(universe):
    df, r, _, _ = universe
    assert all(-1 - 1e-9 <= x["corr"] <= 1 + 1e-9 for x in dp.corr_matrix(r).collect())
    assert all(x["max_drawdown"] <= x["drawdown"] <= 0 for x in rt.drawdown(df).collect())


def test_equity_reconciles_with_costs(universe):
    df, *_ = universe
    out = bt.backtest(df, bt.sma_cross(3, 8)).toPandas().sort_values(["symbol", "ts"])
    for _, g in out.groupby("symbol"):
        assert np.allclose(np.log(g["equity"]), np.cumsum(g["log_return"] * g["position"] - g["cost"]))
        assert (g["position"].iloc[1:].values == g["signal"].iloc[:-1].values).all()
    with pytest.raises(ValueError):
        bt.sma_cross(5, 5)


def test_average_correlation_without_pairs(universe):
    _, r, _, _ = universe
    wide = r.toPandas().pivot(index="ts", columns="symbol", values="ret").sort_index()
    got = {x["ts"]: x["avg_corr"] for x in dp.avg_pairwise_corr(r, 30).collect()}
    last = wide.tail(30).corr().values
    assert got[wide.index[-1].to_pydatetime()] == pytest.approx(last[np.triu_indices_from(last, 1)].mean(), abs=1e-9)
    assert len(got) == len(wide) - 29
