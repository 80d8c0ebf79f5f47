"""The driver contract and a sample of queries against their oracle on the smallest tables (all of them: tools/check.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, key, norm

SAMPLE = ["flagship_sharpe_leaders", "E1_sma", "E2_ema", "E6_adx", "C11_dq_report", "D6_interpolate_linear", "D18_vol_regime", "F14_hist_cvar", "F10_avg_pairwise_corr",
          "G7_regime_history", "H8_composite_score", "I8_apply_tier_limits", "J7_validate_signals", "M4_position_rollup", "N1_performance_analytics",
          "O8_trade_drawdown", "P10_pair_performance", "R1_label_winning_trades", "T5_density", "A5_parse_candle_json", "B6_update_plan", "S1_trades_to_bars"]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "close", "vol", "sharpe"] and df.count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 240


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_equals_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    rel = duck.sql(entry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=key)
    assert got == want


def test_elbow_and_forests_have_the_reference_size(spark, sf, monkeypatch):
    from candlewick.operators import learning

    ks, trees = [], []
    monkeypatch.setattr(learning, "elbow", lambda points, largest=29: ks.append(largest) or points)
    monkeypatch.setattr(learning, "classify", lambda data, *a, trees_=trees, **k: trees_.append(k.get("trees")) or data)
    monkeypatch.setattr(learning, "replay", lambda data: data.select("close"))
    for name in ("Q3_elbow", "R5_random_forest", "R7_replay_predictions"):
        entry.queries()[name](spark, sf)
    assert ks == [29] and trees == [10_000] * 2
