"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and executed in full into a sink that keeps nothing. Cached tables are dropped before every query, so
no query profits from an earlier one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = ("flagship_sharpe_leaders", "E1_sma", "E2_ema", "E7_rsi", "E15_bollinger", "E29_all_indicators", "D4_resample", "D6_interpolate_linear",
           "D8_winsorize", "D13_corr_matrix", "C11_dq_report", "F4_rolling_volatility", "F14_hist_cvar", "F18_stat_summary",
           "F19_pair_corr_static", "F16_coint_scan", "G5_classify_regime", "H8_composite_score", "I9_allocation_weights", "J8_combine_signals",
           "L7_random_portfolios", "O4_backtest_stats", "P10_pair_performance", "B1_merge_bars", "T6_box_stats", "S1_trades_to_bars")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from candlewick import plans
    from candlewick.plans.registry import QUERIES as ALL
    from candlewick.session import build_session
    plans.load_all()
    # the files are small here: finer splits and as many shuffle partitions as cores
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": "2m",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ALL["flagship_sharpe_leaders"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM up
    times = {}
    for name in QUERIES:
        spark.catalog.clearCache()
        start = time.perf_counter()
        ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
