"""Performance and health tables from run records keyed (portfolio, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.guards import div
from candlewick.functions.windows import over

TYPES = {"daily_dca": "dca_workflows", "monthly_rebalance": "rebalance_workflows", "full_pipeline": "pipeline_workflows"}


def analytics(records: DataFrame, year: float = 252.0) -> DataFrame:
    """Span, growth, annual return and risk, worst drawdown and workflow counts per portfolio."""
    s = over(records, by=("portfolio",))
    rows = records.withColumn("_d", div("portfolio_value", F.max("portfolio_value").over(s.running)) - 1)
    r = F.col("daily_return")
    return rows.groupBy("portfolio").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("total_days"),
        F.sum("amount_invested").alias("total_invested"), F.max_by("portfolio_value", "ts").alias("final_value"),
        (div(F.max_by("portfolio_value", "ts"), F.min_by("portfolio_value", "ts")) - 1).alias("total_return"),
        (F.avg(r) * year).alias("annual_return"), (F.stddev_samp(r) * year ** 0.5).alias("annual_volatility"),
        div(F.avg(r) * year, F.stddev_samp(r) * year ** 0.5).alias("sharpe"), F.min("_d").alias("max_drawdown"),
        *[F.count_if(F.col("workflow_type") == t).alias(n) for t, n in TYPES.items()])


def health_status(records: DataFrame, failure: float = 0.1, loss: float = 0.05, drawdown: float = 0.3) -> DataFrame:
    """Alerts of each record and the status they add up to."""
    c = F.col
    alerts = F.array_compact(F.array(
        F.when(div("orders_failed", F.greatest(c("orders_submitted"), F.lit(1))) > failure, "execution failures"),
        F.when(c("daily_return") < -loss, "daily loss"), F.when(c("drawdown") > drawdown, "drawdown")))
    return records.withColumn("alerts", alerts).withColumn(
        "status", F.when(F.size("alerts") > 2, "error").when(F.size("alerts") > 0, "warning").otherwise("healthy"))


def run_metrics(records: DataFrame, as_of: str, recent: int = 10, window: int = 50) -> DataFrame:
    """Runs, orders and money of the day, mean of the last durations, success share of the last runs."""
    back = over(records, by=("portfolio",)).from_last()
    today = F.to_date("ts") == F.lit(as_of).cast("date")
    return records.withColumn("_b", back).groupBy("portfolio").agg(
        F.count_if(today).alias("runs_today"), F.avg(F.when(F.col("_b") <= recent, F.col("duration"))).alias("avg_duration"),
        F.avg(F.when(F.col("_b") <= window, F.col("workflow_status").contains("success").cast("double"))).alias("success_rate"),
        F.coalesce(F.sum(F.when(today, F.col("amount_invested"))), F.lit(0.0)).alias("invested_today"),
        F.coalesce(F.sum(F.when(today, F.col("orders_submitted"))), F.lit(0)).alias("orders_today"))


def staleness_gate(bars: DataFrame, as_of: str, min_symbols: int = 10, max_hours: float = 24.0) -> DataFrame:
    """One row: reuse the data when it is wide and fresh enough, else update."""
    hours = F.timestamp_diff("SECOND", F.col("newest"), F.lit(as_of).cast("timestamp_ntz")) / 3600.0
    return bars.agg(F.count_distinct("symbol").alias("symbols"), F.max("ts").alias("newest")).withColumn("age_hours", hours).withColumn(
        "action", F.when((F.col("symbols") > min_symbols) & (F.col("age_hours") < max_hours), "reuse").otherwise("update"))


def status_report(records: DataFrame, as_of: str) -> DataFrame:
    """Newest run of each portfolio with its counts."""
    today = F.to_date("ts") == F.lit(as_of).cast("date")
    return records.groupBy("portfolio").agg(
        F.max_by(F.struct("ts", "workflow_status", "portfolio_value", "daily_return", "drawdown"), "ts").alias("l"),
        F.count(F.lit(1)).alias("workflows"), F.count_if(today).alias("workflows_today")).select(
            "portfolio", F.col("l.ts").alias("last_run"), "l.workflow_status", "l.portfolio_value", "l.daily_return", "l.drawdown",
            "workflows", "workflows_today")


def availability(bars: DataFrame, assets: DataFrame, category: str = "sector") -> DataFrame:
    """Symbols with bars per category."""
    seen = bars.select("symbol").distinct()
    return assets.join(seen, "symbol", "left_semi").groupBy(category).agg(F.count_distinct("symbol").alias("symbols"))
