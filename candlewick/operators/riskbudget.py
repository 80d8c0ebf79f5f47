"""Equal risk contribution: weights with which every asset adds the same to the portfolio's risk.

The unscaled weights w solve w_i (C w)_i = 1 / n. Each round solves every asset's own quadratic with the others held, and takes the geometric mean with
the last value, which keeps weights positive and calms the rounds. State is a stored table keyed by (universe, asset), written every few rounds; a
universe that is done leaves the table of those still at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.tables import stored
from candlewick.operators.views import _whole

#: Rounds between two writes.
ROUNDS = 6


def _pulled(state: DataFrame, matrix: DataFrame) -> DataFrame:
    """state with `rest`: covariance with the others as weighted, and `own`: variance."""
    other = state.select("universe", F.col("symbol").alias("asset_j"), F.col("w").alias("wj"))
    sums = matrix.join(other, ["universe", "asset_j"]).groupBy("universe", F.col("asset_i").alias("symbol")).agg(
        F.sum(F.when(F.col("asset_i") != F.col("asset_j"), F.col("cov") * F.col("wj")).otherwise(0.0)).alias("rest"),
        F.max(F.when(F.col("asset_i") == F.col("asset_j"), F.col("cov"))).alias("own"))
    return state.join(sums, ["universe", "symbol"])


def equal_risk_weights(cov: DataFrame, tolerance: float = 1e-7, most: int = 600) -> DataFrame:
    """(universe, symbol, weight, risk_share, converged) for half-stored (universe, asset_i, asset_j, cov); weights of a universe sum to 1.

    A universe stops when no risk share is more than `tolerance` from 1 / n; one that has not after `most` rounds is given as it stands,
    with converged false. Assets without variance are left out.
    """
    matrix = stored(_whole(cov.filter(F.col("cov").isNotNull())), "risk-pairs")
    alive = matrix.filter("asset_i = asset_j and cov > 0").select("universe", F.col("asset_i").alias("symbol"), F.col("cov").alias("var"))
    counts = alive.groupBy("universe").agg(F.count(F.lit(1)).alias("n"))
    # inverse deviations are the solution where all correlations are equal
    state = stored(alive.join(counts, "universe").select("universe", "symbol", "n", (1 / (F.sqrt("var") * F.col("n"))).alias("w")), "risk-state")
    done = []
    for k in range(0, most, ROUNDS):
        for _ in range(ROUNDS):
            met = _pulled(state, matrix)
            root = (F.sqrt(F.col("rest") * F.col("rest") + 4 * F.col("own") / F.col("n")) - F.col("rest")) / (2 * F.col("own"))
            state = met.select("universe", "symbol", "n", F.sqrt(F.col("w") * root).alias("w"))
        now = _pulled(state, matrix).withColumn("risk", F.col("w") * (F.col("rest") + F.col("own") * F.col("w")))
        sums = now.groupBy("universe").agg(F.sum("w").alias("ws"), F.sum("risk").alias("rs"))
        shares = now.join(sums, "universe").select("universe", "symbol", "n", "w", (F.col("w") / F.col("ws")).alias("weight"), (F.col("risk") / F.col("rs")).alias("risk_share"))
        worst = shares.groupBy("universe").agg((F.max(F.abs(F.col("risk_share") - 1 / F.col("n"))) <= tolerance).alias("converged"))
        table = stored(shares.join(worst, "universe"), "risk-state")
        last = k + ROUNDS >= most
        done.append((table if last else table.filter("converged")).select("universe", "symbol", "weight", "risk_share", "converged"))
        state = table.filter("not converged").select("universe", "symbol", "n", "w")
        if last or state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
