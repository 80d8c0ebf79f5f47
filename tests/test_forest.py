"""Forests on cells, and quantiles so far, against plain twins."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions.orderstats import expanding_quantile
from candlewick.operators import forest, learning

START = dt.datetime(2024, 1, 1)
FORM = "symbol string, ts timestamp_ntz, close double, label string, above int, part string, x double, y double"


@pytest.fixture(scope="module")
def rows(spark):
    """buy where x + y is above 1, with a margin; y may be null."""
    r, out = random.Random(1), []
    while len(out) < 1500:
        x, y = r.random(), r.random()
        if abs(x + y - 1) > 0.1:
            out.append(("A", START + dt.timedelta(hours=len(out)), x, "buy" if x + y > 1 else "stop", 0, "train" if len(out) % 3 else "test", x, y))
    return spark.createDataFrame([*out, ("B", START, 1.0, "stop", 0, "test", 0.0, None)], FORM).repartition(3)


def test_forest_separates_and_does_not_depend_on_tasks(rows):
    one = forest.forest(rows, ("x", "y"), trees=60, per_task=60).collect()
    other = {(r.symbol, r.ts): r.vote for r in forest.forest(rows, ("x", "y"), trees=60, per_task=7).collect()}
    assert len(one) == 501 == len(other) and all(np.isclose(other[r.symbol, r.ts], r.vote) and 0 <= r.vote <= 1 for r in one)
    hits = learning.confusion(rows.sparkSession.createDataFrame([(r.label, r.predicted) for r in one], "label string, predicted string")).collect()
    assert sum(h.rows for h in hits) == 501 and sum(h.rows for h in hits if h.label == h.predicted) > 0.97 * 501


def test_one_deep_tree_is_the_table_of_cells(rows):
    """Without sampling and with enough depth, a tree gives each cell its own share."""
    class Once:
        def poisson(self, counts):
            return counts

        def random(self, shape):
            return np.random.default_rng(0).random(shape)

    cells = np.array([(a, b) for a in range(6) for b in range(6)])
    counts = np.random.default_rng(2).integers(0, 9, (36, 2)) + 1
    share = forest.grow(cells, counts, np.ones(2), Once(), 40, 6)
    assert np.allclose(share, counts[:, 1] / counts.sum(1))


def test_balanced_forests_and_no_training_rows(rows):
    votes = {b: forest.forest(rows.withColumn("label", F.when(F.col("x") > 0.9, "buy").otherwise("stop")), ("y",), 40, balanced=b).agg(F.avg("vote")).first()[0] for b in (False, True)}
    assert abs(votes[False] - 0.1) < 0.05 and abs(votes[True] - 0.5) < 0.1
    none = forest.forest(rows.filter("part = 'test'"), ("x", "y"), 5)
    assert none.count() == 501 and none.filter("predicted = 'buy'").count() == 0


@pytest.mark.parametrize("q", [0.5, 0.1])
def test_expanding_quantile(spark, q):
    r, data, want = random.Random(3), [], {}
    for s, n in (("A", 140), ("B", 1), ("C", 7), ("D", 30)):
        seen = []
        for t in range(n):
            v = None if r.random() < 0.15 else float(r.randrange(12)) if s == "D" else r.gauss(0, 1)
            data.append((s, START + dt.timedelta(hours=t), v, "extra"))
            if v is not None:
                seen.append(v)
            want[s, START + dt.timedelta(hours=t)] = float(np.quantile(seen, q)) if seen else None
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, vol double, p string").repartition(3)
    got = {(x.symbol, x.ts): x.out for x in expanding_quantile(df, "vol", "out", q).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or np.isclose(got[k], want[k])) for k in want)
