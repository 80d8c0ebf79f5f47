"""Forests of any number of trees: Spark folds the training rows to cells, tasks grow seeded trees on the cells, votes are added up.

Features are cut at quantiles into at most BINS bins, as tree learners do, so rows with equal bins are one cell and the cells are bounded by the bins, whatever
the rows. A bootstrap sample draws every row about once: a Poisson count, and the count of a cell with n rows is Poisson with mean n. So a tree grown on cells
has the distribution of one grown on rows. A tree is a function of its number and the seed, hence a lost task costs only its trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.tables import stored

BINS = 32
#: Cells that are sent to the tasks, at most: some megabytes. More are an error, and fewer bins or features the way out.
CELLS = 1 << 17
#: Trees that one task grows, about.
PER_TASK = 100


def cuts(rows: DataFrame, features: tuple[str, ...], bins: int = BINS) -> list[list[float]]:
    """Ascending cut points of each feature at its quantiles, fewer than bins each."""
    levels = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    one = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), levels).alias(f) for f in features]).first()
    return [sorted(set(one[f] or [])) for f in features]


def binned(rows: DataFrame, features: tuple[str, ...], points: list[list[float]]) -> DataFrame:
    """rows with `_b0`, `_b1`, ...: how many cut points of a feature are below the value."""
    def place(name: str, at: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c < F.col(name))) if at else F.lit(0)

    return rows.withColumns({f"_b{k}": place(f, p) for k, (f, p) in enumerate(zip(features, points, strict=True))})


def grow(cells: np.ndarray, counts: np.ndarray, weights: np.ndarray, rng: np.random.Generator, depth: int, bins: int) -> np.ndarray:
    """Share of the second class that one tree gives to every cell. cells: (n, features) bins; counts: (n, 2) rows; weights: of both classes.

    Entropy splits; at each node the best of a random choice of features, the root of their number rounded up.
    """
    n, features = cells.shape
    drawn = rng.poisson(counts) * weights
    chosen = int(np.ceil(np.sqrt(features)))
    node, share = np.zeros(n, np.int64), np.zeros(n)
    for level in range(depth + 1):
        size = int(node.max()) + 1
        live = node >= 0
        total = np.stack([np.bincount(node[live], drawn[live, k], size) for k in (0, 1)], 1)
        weight = total.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(weight > 0, total[:, 1] / weight, 0.0)
        share[live] = mean[node[live]]
        if level == depth:
            break
        best, gain = np.full(size, -1), np.full(size, 1e-12)
        cut = np.zeros(size, np.int64)
        may = rng.random((size, features)).argsort(axis=1)[:, :chosen]
        for f in range(features):
            key = node[live] * bins + cells[live, f]
            left = np.stack([np.bincount(key, drawn[live, k], size * bins).reshape(size, bins) for k in (0, 1)], 2).cumsum(axis=1)[:, :-1]
            right = total[:, None, :] - left
            gained = _disorder(total)[:, None] - _disorder(left) - _disorder(right)
            gained[(left.sum(2) <= 0) | (right.sum(2) <= 1e-9)] = 0.0
            at = gained.argmax(axis=1)
            top = gained[np.arange(size), at]
            better = (top > gain) & (may == f).any(axis=1)
            gain[better], best[better], cut[better] = top[better], f, at[better]
        split = live & (best[np.maximum(node, 0)] >= 0)
        if not split.any():
            break
        mine = node[split]
        side = cells[split, best[mine]] > cut[mine]
        new = np.full(n, -1)
        # only nodes that are split go on, numbered without gaps
        new[split] = np.unique(2 * mine + side, return_inverse=True)[1]
        node = new
    return share


def _disorder(counts: np.ndarray) -> np.ndarray:
    """Entropy times weight."""
    counts = np.maximum(counts, 0)
    total = counts.sum(-1)
    x = lambda v: v * np.log(np.where(v > 0, v, 1))
    return x(total) - x(counts).sum(-1)


def forest(split: DataFrame, features: tuple[str, ...], trees: int = 100, depth: int = 10, seed: int = 0, balanced: bool = False, bins: int = BINS,
           per_task: int = PER_TASK) -> DataFrame:
    """Test rows of split (part 'train' or 'test', label 'buy' or 'stop', features) with `vote`, the mean share of buy over all trees, and `predicted`.

    `balanced` weighs rows so that both classes count the same. Rows with a null feature are in the lowest bin. Without training rows all are 'stop'.
    """
    train = split.filter("part = 'train'")
    points = cuts(train, features, bins)
    names = [f"_b{k}" for k in range(len(features))]
    of = lambda label: F.count_if((F.col("part") == "train") & (F.col("label") == label))
    cells = stored(binned(split, features, points).groupBy(*names).agg(of("stop").alias("stop"), of("buy").alias("buy")), "forest-cells")
    if cells.count() > CELLS:
        raise ValueError(f"over {CELLS} cells: fewer bins or features")
    table = np.array([tuple(r) for r in cells.orderBy(*names).collect()], np.int64).reshape(-1, len(names) + 2)
    own, counts = table[:, :len(names)], table[:, len(names):]
    weights = np.ones(2)
    if balanced and counts.sum():
        share = counts[:, 1].sum() / counts.sum()
        weights = np.array([share, 1 - share])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, seen = np.zeros(len(own)), 0
        for batch in batches:
            for number in batch.column(0).to_pylist():
                votes += grow(own, counts, weights, np.random.default_rng([seed, number]), depth, bins)
                seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays([*[pa.array(own[:, k], pa.int32()) for k in range(own.shape[1])], pa.array(votes), pa.array(np.full(len(own), seen), pa.int64())],
                                             [*names, "votes", "trees"])

    spark = split.sparkSession
    grown = spark.range(0, trees, 1, max(1, -(-trees // per_task))).mapInArrow(work, ", ".join(f"{b} int" for b in names) + ", votes double, trees long")
    total = stored(grown.groupBy(*names).agg((F.sum("votes") / F.sum("trees")).alias("vote")), "forest-votes")
    test = binned(split.filter("part = 'test'"), features, points).join(total, names).drop(*names)
    # a sum of equal halves in any order must not tip
    return test.withColumn("predicted", F.when(F.round("vote", 9) > 0.5, "buy").otherwise("stop"))
