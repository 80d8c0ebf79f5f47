"""Trade lists and execution accounting in table form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def required_trades(target: DataFrame, current: DataFrame, capital: float, step: float = 0.001, smallest: float = 25.0) -> DataFrame:
    """Orders that move current to target weights; only symbols of the target are traded."""
    both = target.select("symbol", F.col("weight").alias("target_weight")).join(
        current.select("symbol", F.col("weight").alias("current_weight")), "symbol", "left").fillna(0.0, ["current_weight"])
    diff = F.col("target_weight") - F.col("current_weight")
    return both.withColumns({"side": F.when(diff > 0, "buy").otherwise("sell"), "amount": F.abs(diff) * capital}).filter(
        (F.abs(diff) >= step) & (F.col("amount") >= smallest))


def risk_check(trades: DataFrame, session: str = "session", order: str = "seq", largest: float = 10_000.0, smallest: float = 25.0,
               daily_trades: int = 50, position: float = 0.05, daily_volume: float = 100_000.0) -> DataFrame:
    """Violations of each order; counts run over the earlier orders of the same session."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = trades.withColumns({"_n": F.count(F.lit(1)).over(before), "_v": F.coalesce(F.sum("amount").over(before), F.lit(0.0))})
    c = F.col
    return out.withColumn("violations", F.array_compact(F.array(
        F.when(c("amount") > largest, "order above maximum"), F.when(c("amount") < smallest, "order below minimum"),
        F.when(c("_n") >= daily_trades, "daily trade limit"),
        F.when((c("side") == "buy") & (c("target_weight") > position), "position limit"),
        F.when(c("_v") + c("amount") > daily_volume, "daily volume limit")))).withColumn(
            "passed", F.size("violations") == 0).drop("_n", "_v")


def dca_allocation(weights: DataFrame, amount: float, start: str, smallest: float = 25.0, threshold: float = 1000.0, parts: int = 4,
                   minutes: int = 30) -> DataFrame:
    """Investment orders per asset; large ones are cut into equal slices spread over time."""
    rows = weights.select("symbol", (F.col("weight") * amount).alias("total")).filter(F.col("total") >= smallest)
    n = F.when(F.col("total") > threshold, parts).otherwise(1)
    cut = rows.withColumn("_n", n).withColumn("slice", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return cut.select("symbol", "slice", (F.col("total") / F.col("_n")).alias("amount"),
                      (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("slice") - 1) * minutes)).alias("ts"))


def position_rollup(fills: DataFrame, order: tuple[str, ...] = ("ts", "trade_id"), unit: str = "day") -> DataFrame:
    """Holdings after all fills, quantity and value each floored at zero after every fill.

    A sum floored at zero ends at total - min(0, lowest running total), so fills are folded per (symbol, time block) to
    their sum and lowest prefix, and only those block rows are put in sequence: no symbol's fills meet in one task.
    """
    signed = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    moves = fills.select("symbol", *order, F.date_trunc(unit, "ts").alias("_b"), (signed * F.col("value") / F.col("price")).alias("q"),
                         (signed * F.col("value")).alias("v"))
    inside = Window.partitionBy("symbol", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    prefix = moves.withColumns({"pq": F.sum("q").over(inside), "pv": F.sum("v").over(inside)})
    blocks = prefix.groupBy("symbol", "_b").agg(F.sum("q").alias("q"), F.sum("v").alias("v"), F.min("pq").alias("pq"),
                                                F.min("pv").alias("pv"), F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("symbol").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    low = {f"l{x}": F.coalesce(F.sum(x).over(before), F.lit(0.0)) + F.col(f"p{x}") for x in ("q", "v")}
    total = blocks.withColumns(low).groupBy("symbol").agg(
        F.sum("k").alias("fills"), *[(F.sum(x) - F.least(F.min(f"l{x}"), F.lit(0.0))).alias(n) for x, n in (("q", "quantity"), ("v", "value"))])
    return total.withColumn("avg_price", F.when(F.col("quantity") > 1e-9, F.col("value") / F.col("quantity")).otherwise(0.0))


def execution_summary(orders: DataFrame, fee: float = 0.005) -> DataFrame:
    """Per session: submitted, filled, failed, success rate, value, slippage, cost, violations."""
    ok = F.col("status") == "filled"
    return orders.groupBy("session").agg(
        F.count(F.lit(1)).alias("submitted"), F.count_if(ok).alias("filled"), F.count_if(~ok).alias("failed"),
        (100 * F.avg(ok.cast("double"))).alias("success_rate"), F.coalesce(F.sum(F.when(ok, F.col("value"))), F.lit(0.0)).alias("value"),
        F.coalesce(F.avg(F.when(ok, F.col("slippage"))), F.lit(0.0)).alias("average_slippage"),
        (F.coalesce(F.sum(F.when(ok, F.col("value"))), F.lit(0.0)) * fee).alias("costs"), F.sum("violations").alias("violations"))


def execution_plan(trades: DataFrame, session: str = "session", order: str = "seq", **limits) -> DataFrame:
    """Approved orders of each session with how many passed and failed."""
    checked = risk_check(trades, session, order, **limits)
    counts = checked.groupBy(session).agg(F.count_if("passed").alias("checks_passed"), F.count_if(~F.col("passed")).alias("checks_failed"))
    return checked.filter("passed").drop("violations", "passed").join(counts, session)


