"""Data quality checks per symbol: bars or asset rows in, check rows and reports out.

One window pass and one aggregate per symbol produce every count the bar checks need; each check is then a projection
of that profile, so adding checks adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.guards import div
from candlewick.functions.windows import over

VALUES = ("open", "high", "low", "close", "volume", "quote_volume")
OPTIONAL_META = ("market_cap_usd", "daily_volume_brl", "listing_date", "sector")
REQUIRED_META = ("symbol", "name", "is_active", "exchange", "source")
MIN_SCORE = 0.7


def bar_profile(bars: DataFrame) -> DataFrame:
    """Counts behind the bar checks, one row per symbol. Returns are taken over the non-null closes."""
    s = over(bars)
    c = F.col
    prior = F.last("close", ignorenulls=True).over(s.w.rowsBetween(-(2 ** 31) + 1, -1))
    step = bars.withColumns({
        "_ret": F.when(c("close").isNotNull(), div("close", prior) - 1),
        "_gap": F.timestamp_diff("SECOND", s.lag("ts"), c("ts")),
        "_median": F.percentile("volume", F.lit(0.5)).over(s.all)})
    step = step.withColumns({
        "_q1": F.percentile("_ret", F.lit(0.25)).over(s.all), "_q3": F.percentile("_ret", F.lit(0.75)).over(s.all),
        "_avg": F.avg("_ret").over(s.all), "_sd": F.stddev_pop("_ret").over(s.all)})
    ordered = (c("low") <= c("open")) & (c("open") <= c("high")) & (c("low") <= c("close")) & (c("close") <= c("high"))
    iqr = c("_q3") - c("_q1")
    bad_price = F.coalesce(c("open") <= 0, F.lit(False))
    for p in ("high", "low", "close"):
        bad_price = bad_price | F.coalesce(c(p) <= 0, F.lit(False))
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return step.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        sum((F.count_if(c(v).isNull()) for v in VALUES), F.lit(0)).alias("nulls"),
        F.count_if(~F.coalesce(ordered, F.lit(False))).alias("ohlc_issues"),
        F.count_if(bad_price).alias("bad_prices"),
        F.count("_ret").alias("returns"), count(F.abs("_ret") > 0.5).alias("jumps"),
        F.count("volume").alias("volumes"), count(c("volume") < 0).alias("negative"),
        count(c("volume") == 0).alias("zero"), count(c("volume") > 10 * c("_median")).alias("spikes"),
        count(F.abs(div(c("_ret") - c("_avg"), "_sd")) > 3).alias("z_outliers"),
        count((c("_ret") < c("_q1") - 1.5 * iqr) | (c("_ret") > c("_q3") + 1.5 * iqr)).alias("iqr_outliers"),
        F.max("ts").alias("latest"), count(c("_gap") == 0).alias("duplicates"),
        F.countDistinct("_gap").alias("intervals"))


def _check(name: str, score: Column, passed: Column, failed_severity: Column | str = "warning") -> Column:
    bad = F.lit(failed_severity) if isinstance(failed_severity, str) else failed_severity
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(F.lit(name).alias("check_name"), ok.alias("passed"), score.cast("double").alias("score"),
                    F.when(ok, "info").otherwise(bad).alias("severity"))


def schema_check(bars: DataFrame) -> Column:
    """Decided on the frame's schema: a missing column is critical, a non-numeric one a warning."""
    kinds = {f.name: f.dataType for f in bars.schema.fields}
    if any(v not in kinds for v in VALUES[:5]):
        score, ok, bad = 0.0, False, "critical"
    elif any(not isinstance(kinds[v], T.NumericType) for v in VALUES[:5]):
        score, ok, bad = 0.3, False, "warning"
    else:
        score, ok, bad = 1.0, True, "info"
    return _check("schema_validation", F.lit(score), F.lit(ok), bad)


def completeness() -> Column:
    ratio = 1 - F.col("nulls") / (F.col("n") * len(VALUES))
    few = F.col("n") < 30
    return _check("completeness_check", F.when(few, 0.2).otherwise(F.least(F.lit(1.0), ratio / 0.95)),
                  ~few & (ratio >= 0.95))


def price_continuity() -> Column:
    score = 0.7 * (1 - F.col("ohlc_issues") / F.col("n")) + 0.3 * (1 - F.coalesce(div("jumps", "returns"), F.lit(0.0)))
    few, critical = F.col("n") < 2, F.col("bad_prices") > 0
    return _check("price_continuity", F.when(few, 1.0).when(critical, 0.0).otherwise(score),
                  few | (~critical & (score >= 0.8) & (F.col("ohlc_issues") == 0)),
                  F.when(critical, "critical").otherwise("warning"))


def volume_patterns() -> Column:
    none, negative = F.col("volumes") == 0, F.col("negative") > 0
    score = (F.when(div("zero", "volumes") > 0.2, 0.7).otherwise(1.0)
             * F.when(div("spikes", "volumes") > 0.1, 0.8).otherwise(1.0))
    return _check("volume_patterns", F.when(none, 0.3).when(negative, 0.0).otherwise(score),
                  ~none & ~negative & (score >= 0.6), F.when(negative, "critical").otherwise("warning"))


def outliers(limit: float = 0.05) -> Column:
    rate = F.coalesce(div(F.greatest("z_outliers", "iqr_outliers"), "returns"), F.lit(0.0))
    few = F.col("n") < 10
    return _check("outlier_detection", F.when(few, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - rate / limit)),
                  few | (rate <= limit))


def freshness(now: str, limit_hours: float = 24.0) -> Column:
    hours = F.timestamp_diff("SECOND", F.col("latest"), F.lit(now).cast("timestamp_ntz")) / 3600.0
    return _check("data_freshness",
                  F.when(hours <= limit_hours / 2, 1.0).when(hours <= limit_hours, 0.8)
                  .otherwise(F.greatest(F.lit(0.0), 1 - hours / (2 * limit_hours))), hours <= limit_hours)


def consistency() -> Column:
    issues = (F.col("duplicates") > 0).cast("int") + ((F.col("n") > 5) & (F.col("intervals") > 3)).cast("int")
    score = F.greatest(F.lit(0.0), 1 - 0.3 * issues)
    checked = _check("consistency_check", score, score >= 0.6)
    return checked.withField("severity", F.when(issues == 0, "info").otherwise("warning"))


def bar_checks(bars: DataFrame, now: str) -> DataFrame:
    """All seven bar checks as an array per symbol."""
    return bar_profile(bars).select("symbol", F.array(
        schema_check(bars), completeness(), price_continuity(), volume_patterns(), outliers(), freshness(now),
        consistency()).alias("checks"))


def one_check(bars: DataFrame, check: Column) -> DataFrame:
    return bar_profile(bars).select("symbol", check.alias("c")).select("symbol", "c.*")


def meta_completeness() -> Column:
    missing = sum(((F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("int") for c in REQUIRED_META), F.lit(0))
    present = sum((F.col(c).isNotNull().cast("int") for c in OPTIONAL_META), F.lit(0))
    return _check("metadata_completeness", F.when(missing > 0, 0.0).otherwise(0.7 + 0.3 * present / 4), missing == 0,
                  "critical")


def meta_issues(now: str, key: str = "symbol") -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(c("symbol") != c(key), "symbol mismatch"),
        F.when(c("market_cap_usd") < 0, "negative market cap").when(c("market_cap_usd") > 1e12, "market cap too large"),
        F.when(c("daily_volume_brl") < 0, "negative daily volume"),
        F.when(c("listing_date") > F.lit(now).cast("timestamp_ntz"), "future listing date")
        .when(c("listing_date") < F.lit("2009-01-01").cast("timestamp_ntz"), "listing date too early")))


def meta_consistency(now: str) -> Column:
    n = F.size(meta_issues(now))
    score = F.greatest(F.lit(0.0), 1 - 0.25 * n)
    return _check("metadata_consistency", score, score >= 0.6).withField(
        "severity", F.when(n == 0, "info").otherwise("warning"))


def meta_freshness() -> Column:
    """Always passes: metadata carries no freshness rule."""
    return _check("metadata_freshness", F.lit(1.0), F.lit(True))


def meta_checks(assets: DataFrame, now: str) -> DataFrame:
    return assets.select("symbol", F.array(meta_completeness(), meta_consistency(now), meta_freshness()).alias("checks"))


def report(checks: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Overall score, level, usability and advice per symbol, from its array of checks."""
    arr = F.col("checks")
    weight = lambda c: F.when(c["severity"] == "critical", 0.4).when(c["severity"] == "warning", 0.35).otherwise(0.25)
    total = lambda f: F.aggregate(arr, F.lit(0.0), lambda a, c: a + f(c))
    failed = lambda sev: F.size(F.filter(arr, lambda c: (c["severity"] == sev) & ~c["passed"]))
    mean = total(lambda c: c["score"]) / F.size(arr)
    weighted = div(total(lambda c: c["score"] * weight(c)), total(weight))
    out = checks.withColumns({"failed_critical": failed("critical"), "failed_warning": failed("warning")})
    out = out.withColumn("overall_score", F.when(F.size(arr) == 0, 0.0).when(
        F.col("failed_critical") > 0, F.least(F.lit(0.3), mean)).otherwise(weighted))
    s = F.col("overall_score")
    out = out.withColumns({
        "quality_level": F.when(s >= 0.9, "excellent").when(s >= 0.8, "good").when(s >= min_score, "acceptable")
        .when(s >= 0.4, "poor").otherwise("unacceptable"),
        "is_usable": (s >= min_score) & (F.col("failed_critical") == 0)})
    advice = F.array_compact(F.array(
        F.when(F.col("failed_critical") > 0, F.format_string("fix %d critical issues", "failed_critical")),
        F.when(F.col("failed_warning") > 0, F.format_string("review %d warnings", "failed_warning")),
        F.when(s < min_score, "below the minimum score: leave out")))
    return out.withColumn("recommendations", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("fit for analysis"))))


def keep_usable(rows: DataFrame, reports: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows whose symbol is usable and scores at least `min_score`."""
    good = reports.filter(F.col("is_usable") & (F.col("overall_score") >= min_score)).select("symbol")
    return rows.join(good, "symbol", "left_semi")


def summary(reports: DataFrame) -> DataFrame:
    """One row over all reports."""
    s = F.col("overall_score")
    level = lambda name: F.count_if(F.col("quality_level") == name).alias(name)
    return reports.agg(
        F.count(F.lit(1)).alias("total_symbols"), F.count_if("is_usable").alias("usable_symbols"),
        F.avg(F.col("is_usable").cast("double")).alias("usable_rate"), F.avg(s).alias("average_score"),
        F.percentile(s, F.lit(0.5)).alias("median_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
        *[level(n) for n in ("excellent", "good", "acceptable", "poor", "unacceptable")],
        F.count_if(F.col("failed_critical") > 0).alias("critical_failures"))
