"""Johansen's test of baskets: how many combinations of several price series are stationary, and which.

Spark aligns each basket's prices and adds up the products of levels, differences and lagged differences in one aggregate; a basket is then a
row of sums, from which a task solves the reduced-rank eigenproblem. Series of any length are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: 90, 95 and 99 % points of the trace and of the largest eigenvalue statistic with a constant, by the number of series less the rank
TRACE_POINTS = {1: (2.7055, 3.8415, 6.6349), 2: (13.4294, 15.4943, 19.9349), 3: (27.0669, 29.7961, 35.4628), 4: (44.4929, 47.8545, 54.6815),
                5: (65.8202, 69.8189, 77.8202), 6: (91.1090, 95.7542, 104.9637)}
LARGEST_POINTS = {1: (2.7055, 3.8415, 6.6349), 2: (12.2971, 14.2639, 18.5200), 3: (18.8928, 21.1314, 25.8650), 4: (25.1236, 27.5858, 32.7172),
                  5: (31.2379, 33.8777, 39.3693), 6: (37.2786, 40.0763, 45.8662)}
#: Series in a basket, at most: those that the points are given for.
LARGEST = max(TRACE_POINTS)
OUT = ("basket string, members array<string>, n long, rank int, eigenvalue double, trace double, trace_95 double, largest double, largest_95 double, "
       "rejected boolean, vector array<double>")


def basket_moments(prices: DataFrame, baskets: DataFrame, lags: int = 1, value: str = "close") -> DataFrame:
    """(basket, members, n, sums): the upper triangle, row by row, of the summed products of (differences, levels before, lagged differences, 1).

    Dates on which a member has no price are left out; a difference is from one kept date to the next. Each series is taken less its mean.
    """
    member = Window.partitionBy("basket").orderBy("symbol")
    listed = baskets.select("basket", "symbol").distinct().withColumns({
        "k": F.row_number().over(member), "size": F.count(F.lit(1)).over(Window.partitionBy("basket"))}).filter(F.col("size") <= LARGEST)
    own = prices.filter(F.col(value).isNotNull()).select("symbol", "ts", (F.col(value) - F.avg(value).over(Window.partitionBy("symbol"))).alias("v"))
    day = own.join(listed, "symbol").groupBy("basket", "ts").agg(F.sort_array(F.collect_list(F.struct("k", "symbol", "v"))).alias("m"), F.max("size").alias("size"))
    rows = day.filter(F.size("m") == F.col("size")).select("basket", "ts", F.col("m.symbol").alias("members"), F.col("m.v").alias("x"))
    by = Window.partitionBy("basket").orderBy("ts")
    less = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    steps = rows.withColumn("before", F.lag("x").over(by)).withColumn("d", less(F.col("x"), F.col("before")))
    parts = steps.withColumns({f"d{k}": F.lag("d", k).over(by) for k in range(1, lags + 1)}).dropna(subset=["d", *[f"d{k}" for k in range(1, lags + 1)]])
    whole = parts.select("basket", "members", F.concat("d", "before", *[f"d{k}" for k in range(1, lags + 1)], F.array(F.lit(1.0))).alias("y"))
    products = F.flatten(F.transform("y", lambda a, i: F.transform(F.slice("y", i + 1, F.size("y")), lambda b: a * b)))
    sums = whole.select("basket", "members", F.posexplode(products).alias("at", "v")).groupBy("basket", "members", "at").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy("basket", "members").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s")).select(
        "basket", "members", "n", F.col("s.v").alias("sums"))


def reduced_rank(sums: np.ndarray, series: int, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenvalues, falling, and the vectors of levels, as columns of unit variance; None where the series are not of full rank."""
    size = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = sums
    m = np.triu(m) + np.triu(m, 1).T
    k = 2 * series
    try:
        # what differences and levels keep after the lagged differences and the constant are taken out
        s = (m[:k, :k] - m[:k, k:] @ np.linalg.solve(m[k:, k:], m[k:, :k])) / n
        low = np.linalg.inv(np.linalg.cholesky(s[series:, series:]))
        half = low @ s[series:, :series]
        values, vectors = np.linalg.eigh(half @ np.linalg.solve(s[:series, :series], half.T))
    except np.linalg.LinAlgError:
        return None
    vectors = (low.T @ vectors)[:, ::-1]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(series)] < 0, -1, 1)
    return np.clip(values[::-1], 0, 1 - 1e-15), vectors


def johansen(prices: DataFrame, baskets: DataFrame, lags: int = 1, value: str = "close") -> DataFrame:
    """One row per basket and rank: the statistics of 'at most `rank` stationary combinations', 95 % points, and the vector of the next combination.

    baskets: (basket, symbol), two to six symbols each; larger ones are left out. Baskets with too few dates for the regression, or whose series
    depend on each other exactly, have one row with rank 0 and null figures.
    """
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for basket, members, n, sums in zip(batch["basket"], batch["members"], batch["n"], batch["sums"], strict=True):
                p = len(members)
                found = reduced_rank(np.asarray(sums), p, n) if n > p * (lags + 2) + 1 else None
                if found is None:
                    rows.append((basket, list(members), n, 0, *[None] * 6, None))
                    continue
                values, vectors = found
                logs = -n * np.log1p(-values)
                for r in range(p):
                    trace, largest = logs[r:].sum(), logs[r]
                    rows.append((basket, list(members), n, r, values[r], trace, TRACE_POINTS[p - r][1], largest, LARGEST_POINTS[p - r][1],
                                 bool(trace > TRACE_POINTS[p - r][1]), vectors[:, r].tolist()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return basket_moments(prices, baskets, lags, value).mapInPandas(solve, OUT)
