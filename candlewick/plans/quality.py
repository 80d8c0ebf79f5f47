"""Queries C1-C13: quality checks over bars with planted defects and over the asset dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import quality as q
from candlewick.plans.registry import register
from candlewick.plans.sqltext import ASSETS, DIRTY, W, ctes, rnd, tidy
from candlewick.sources.market import assets, dirty_bars

NOW = "2001-11-04 12:00:00"

PROFILE = {
    "bars": DIRTY,
    "prior": f"""SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
        date_diff('second', lag(ts) OVER {W}, ts) AS gap FROM bars""",
    "rets": "SELECT *, CASE WHEN close IS NOT NULL THEN close / nullif(pc, 0) - 1 END AS r FROM prior",
    "stats": """SELECT symbol, median(volume) AS med, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3,
        avg(r) AS ravg, stddev_pop(r) AS rsd FROM rets GROUP BY symbol""",
    "prof": """SELECT symbol, count(*) AS n,
        sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT + (quote_volume IS NULL)::INT) AS nulls,
        count_if(NOT coalesce(low <= open AND open <= high AND low <= close AND close <= high, false)) AS ohlc_issues,
        count_if(coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false) OR coalesce(close <= 0, false)) AS bad_prices,
        count(r) AS nret, count_if(abs(r) > 0.5) AS jumps, count(volume) AS volumes, count_if(volume < 0) AS negative,
        count_if(volume = 0) AS zero, count_if(volume > 10 * med) AS spikes,
        count_if(abs((r - ravg) / nullif(rsd, 0)) > 3) AS zo,
        count_if(r < q1 - 1.5 * (q3 - q1) OR r > q3 + 1.5 * (q3 - q1)) AS io, max(ts) AS latest,
        count_if(gap = 0) AS duplicates, count(DISTINCT gap) AS intervals FROM rets JOIN stats USING (symbol) GROUP BY symbol""",
}


def chk(name: str, score: str, passed: str, bad: str = "'warning'") -> str:
    return (f"SELECT symbol, '{name}' AS check_name, coalesce({passed}, false) AS passed, CAST({score} AS DOUBLE) AS score, "
            f"CASE WHEN coalesce({passed}, false) THEN 'info' ELSE {bad} END AS severity FROM ")


RATIO = "(1 - nulls / (n * 6.0))"
CONT = "(0.7 * (1 - ohlc_issues / CAST(n AS DOUBLE)) + 0.3 * (1 - coalesce(jumps / nullif(nret, 0), 0)))"
VOL = "((CASE WHEN zero / volumes > 0.2 THEN 0.7 ELSE 1.0 END) * (CASE WHEN spikes / volumes > 0.1 THEN 0.8 ELSE 1.0 END))"
RATE = "coalesce(greatest(zo, io) / nullif(nret, 0), 0)"
HOURS = f"(date_diff('second', latest, TIMESTAMP '{NOW}') / 3600.0)"
ISSUES = "((duplicates > 0)::INT + (n > 5 AND intervals > 3)::INT)"
CHECKS = {
    "C1_dq_schema": chk("schema_validation", "1.0", "true") + "prof",
    "C2_dq_completeness": chk("completeness_check", f"CASE WHEN n < 30 THEN 0.2 ELSE least(1, {RATIO} / 0.95) END",
                              f"n >= 30 AND {RATIO} >= 0.95") + "prof",
    "C3_dq_price_continuity": chk(
        "price_continuity", f"CASE WHEN n < 2 THEN 1 WHEN bad_prices > 0 THEN 0 ELSE {CONT} END",
        f"n < 2 OR (bad_prices = 0 AND {CONT} >= 0.8 AND ohlc_issues = 0)",
        "CASE WHEN bad_prices > 0 THEN 'critical' ELSE 'warning' END") + "prof",
    "C4_dq_volume": chk("volume_patterns", f"CASE WHEN volumes = 0 THEN 0.3 WHEN negative > 0 THEN 0 ELSE {VOL} END",
                        f"volumes > 0 AND negative = 0 AND {VOL} >= 0.6",
                        "CASE WHEN negative > 0 THEN 'critical' ELSE 'warning' END") + "prof",
    "C5_dq_outliers": chk("outlier_detection", f"CASE WHEN n < 10 THEN 1 ELSE greatest(0, 1 - {RATE} / 0.05) END",
                          f"n < 10 OR {RATE} <= 0.05") + "prof",
    "C6_dq_freshness": chk("data_freshness", f"CASE WHEN {HOURS} <= 12 THEN 1 WHEN {HOURS} <= 24 THEN 0.8 "
                           f"ELSE greatest(0, 1 - {HOURS} / 48) END", f"{HOURS} <= 24") + "prof",
    "C7_dq_consistency": f"SELECT symbol, 'consistency_check' AS check_name, 1 - 0.3 * {ISSUES} >= 0.6 AS passed, "
                         f"CAST(greatest(0, 1 - 0.3 * {ISSUES}) AS DOUBLE) AS score, "
                         f"CASE WHEN {ISSUES} = 0 THEN 'info' ELSE 'warning' END AS severity FROM prof",
}
SPARK = {"C2_dq_completeness": q.completeness, "C3_dq_price_continuity": q.price_continuity,
         "C4_dq_volume": q.volume_patterns, "C5_dq_outliers": q.outliers, "C6_dq_freshness": lambda: q.freshness(NOW),
         "C7_dq_consistency": q.consistency}


def _schema(spark, d):
    bars = dirty_bars(spark, d)
    return bars.select("symbol").distinct().select("symbol", q.schema_check(bars).alias("c")).select("symbol", "c.*")


OUT = f"SELECT symbol, check_name, passed, {rnd('score')}, severity FROM "
register("C1_dq_schema", _schema, ctes(f"{OUT} ({CHECKS['C1_dq_schema']})", **PROFILE))
for _name, _make in SPARK.items():
    register(_name, lambda spark, d, make=_make: rounded(q.one_check(dirty_bars(spark, d), make())),
             ctes(f"{OUT} ({CHECKS[_name]})", **PROFILE))

PRESENT = ("((market_cap_usd IS NOT NULL)::INT + (daily_volume_brl IS NOT NULL)::INT + (listing_date IS NOT NULL)::INT "
           "+ (sector IS NOT NULL)::INT)")
MISSING = "(name IS NULL OR name = '' OR is_active IS NULL OR exchange IS NULL OR exchange = '' OR source IS NULL)"
MI = (f"((market_cap_usd < 0 OR market_cap_usd > 1e12)::INT + coalesce((daily_volume_brl < 0)::INT, 0) + coalesce("
      f"(listing_date > TIMESTAMP '{NOW}' OR listing_date < TIMESTAMP '2009-01-01')::INT, 0))")
META = {
    "C8_dq_meta_completeness": chk("metadata_completeness", f"CASE WHEN {MISSING} THEN 0 ELSE 0.7 + 0.3 * {PRESENT} / 4 END",
                                   f"NOT {MISSING}", "'critical'") + "assets",
    "C9_dq_meta_consistency": f"SELECT symbol, 'metadata_consistency' AS check_name, 1 - 0.25 * {MI} >= 0.6 AS passed, "
                              f"CAST(greatest(0, 1 - 0.25 * {MI}) AS DOUBLE) AS score, "
                              f"CASE WHEN {MI} = 0 THEN 'info' ELSE 'warning' END AS severity FROM assets",
    "C10_dq_meta_freshness": chk("metadata_freshness", "1.0", "true") + "assets",
}
for _name, _make in {"C8_dq_meta_completeness": q.meta_completeness,
                     "C9_dq_meta_consistency": lambda: q.meta_consistency(NOW),
                     "C10_dq_meta_freshness": q.meta_freshness}.items():
    register(_name, lambda spark, d, make=_make: rounded(
        assets(spark, d).select("symbol", make().alias("c")).select("symbol", "c.*")),
        ctes(f"{OUT} ({META[_name]})", assets=ASSETS))

REPORT = {
    **PROFILE, "checks": " UNION ALL ".join(CHECKS.values()),
    "w": "SELECT *, CASE severity WHEN 'critical' THEN 0.4 WHEN 'warning' THEN 0.35 ELSE 0.25 END AS wt FROM checks",
    "agg": """SELECT symbol, count_if(severity = 'critical' AND NOT passed) AS failed_critical,
        count_if(severity = 'warning' AND NOT passed) AS failed_warning, avg(score) AS mean,
        sum(score * wt) / sum(wt) AS weighted FROM w GROUP BY symbol""",
    "scored": "SELECT *, CASE WHEN failed_critical > 0 THEN least(0.3, mean) ELSE weighted END AS overall_score FROM agg",
    "reports": """SELECT *, CASE WHEN overall_score >= 0.9 THEN 'excellent' WHEN overall_score >= 0.8 THEN 'good'
        WHEN overall_score >= 0.7 THEN 'acceptable' WHEN overall_score >= 0.4 THEN 'poor' ELSE 'unacceptable' END AS quality_level,
        overall_score >= 0.7 AND failed_critical = 0 AS is_usable FROM scored""",
}


def reports_of(spark, d):
    return q.report(q.bar_checks(dirty_bars(spark, d), NOW))


register("C11_dq_report", lambda spark, d: rounded(reports_of(spark, d).select(
    "symbol", "overall_score", "quality_level", "is_usable", "failed_critical", "failed_warning",
    F.concat_ws("; ", "recommendations").alias("recommendations"))),
    ctes(f"""SELECT symbol, {rnd('overall_score')}, quality_level, is_usable, failed_critical, failed_warning,
    CASE WHEN failed_critical + failed_warning = 0 AND overall_score >= 0.7 THEN 'fit for analysis' ELSE
    concat_ws('; ', CASE WHEN failed_critical > 0 THEN 'fix ' || failed_critical || ' critical issues' END,
      CASE WHEN failed_warning > 0 THEN 'review ' || failed_warning || ' warnings' END,
      CASE WHEN overall_score < 0.7 THEN 'below the minimum score: leave out' END) END AS recommendations FROM reports""", **REPORT))

register("C12_dq_filter", lambda spark, d: q.keep_usable(dirty_bars(spark, d), reports_of(spark, d)).select(
    "symbol", "ts", "close", "volume"),
    ctes("SELECT symbol, ts, close, volume FROM bars JOIN (SELECT symbol FROM reports WHERE is_usable) USING (symbol)", **REPORT))

register("C13_dq_summary", lambda spark, d: rounded(q.summary(reports_of(spark, d))), ctes(
    f"""SELECT count(*) AS total_symbols, count_if(is_usable) AS usable_symbols, {tidy('avg(is_usable::INT)')} AS usable_rate,
    {tidy('avg(overall_score)')} AS average_score, {tidy('median(overall_score)')} AS median_score,
    {tidy('min(overall_score)')} AS min_score, {tidy('max(overall_score)')} AS max_score,
    {', '.join(f"count_if(quality_level = '{n}') AS {n}" for n in ('excellent', 'good', 'acceptable', 'poor', 'unacceptable'))},
    count_if(failed_critical > 0) AS critical_failures FROM reports""", **REPORT))
