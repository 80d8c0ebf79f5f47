"""Pairs of packs of series: read from the storage as they lie there."""

import math

import numpy as np
import pandas as pd
import pytest
from toys import bars

from candlewick.functions import blocks as bl
from candlewick.functions.guards import rounded


@pytest.fixture(scope="module")
def uneven(spark):
    """Series with own first dates and gaps, one flat, one of a single value, one empty."""
    r = np.random.default_rng(4)
    data = {f"S{i:02d}": [None] * (i % 7) + [None if r.random() < 0.2 else float(v) for v in r.normal(100, 5, 50 - i % 7)] for i in range(40)}
    data |= {"FLAT": [3.0] * 50, "ONE": [None] * 20 + [1.0], "NONE": [None] * 50}
    return data, bars(spark, data).select("symbol", "ts", "close").cache()


def test_series_are_not_sent_to_every_partner(uneven):
    """Each block was copied to all block pairs in a shuffle, which grew with the square of the input."""
    plan = bl.pair_corrs(uneven[1], "close", blocks=5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan


@pytest.mark.parametrize("blocks", [None, 1, 4, 7])
def test_every_pair_once_whatever_the_packs(uneven, blocks):
    data, df = uneven
    wide = pd.DataFrame({k: pd.Series(v, dtype=float) for k, v in data.items()})
    want, both = wide.corr(min_periods=1), wide.notna().astype(int).T @ wide.notna().astype(int)
    got = bl.pair_corrs(df, "close", blocks).toPandas()
    assert (got["asset_i"] < got["asset_j"]).all() and not got.duplicated(["asset_i", "asset_j"]).any()
    assert len(got) == (np.triu(both.to_numpy(), 1) > 0).sum()
    for r in got.itertuples():
        c = want.loc[r.asset_i, r.asset_j]
        assert r.n == both.loc[r.asset_i, r.asset_j]
        assert (math.isnan(c) and math.isnan(r.corr)) or r.corr == pytest.approx(c, abs=1e-9)
    own = bl.pair_moments(df, "close", blocks).filter("asset_i = asset_j").toPandas()
    assert sorted(own["asset_i"]) == sorted(set(data) - {"NONE"})


def test_a_pack_of_several_tiles_and_stretches(uneven, monkeypatch):
    monkeypatch.setattr(bl, "TILE", 6), monkeypatch.setattr(bl, "DATES", 9)
    block = lambda names: bl._Block(*(c[0].as_py() for c in next(bl._pack(iter([table(names)]))).columns[1:]))
    r = np.random.default_rng(6)
    t = {n: np.sort(r.choice(60, 25, replace=False)) for n in (f"S{i:02d}" for i in range(16))}
    v = {n: r.normal(size=25) for n in t}

    def table(names):
        rows = [(n, bl.zlib.compress(np.diff(t[n][part], prepend=0).astype(np.int64).tobytes()), v[n][part].tobytes(), 0)
                for n in names for part in (slice(12, None), slice(0, 12))]
        return bl.pa.RecordBatch.from_arrays([bl.pa.array(x) for x in zip(*rows)], ["symbol", "t", "v", "_pack"])

    names = sorted(t)
    a, b = block(names[:9]), block(names[9:])
    times = np.union1d(a.times, b.times)
    a.among(times), b.among(times)
    s = bl._sums(a, 6, b, 0, len(times))
    for i, x in enumerate(names[6:9]):
        for j, y in enumerate(names[9:15]):
            _, p, q = np.intersect1d(t[x], t[y], return_indices=True)
            assert s["n"][i, j] == len(p) and s["sxy"][i, j] == pytest.approx(((v[x] - v[x].mean())[p] * (v[y] - v[y].mean())[q]).sum(), abs=1e-12)


def test_tidied_in_the_tile(uneven):
    got, want = bl.pair_corrs(uneven[1], "close", digits=6), rounded(bl.pair_corrs(uneven[1], "close"))
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
