"""Queries Q1-Q5, R1-R7: clustering and classification over daily supplier bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.guards import rounded
from candlewick.operators import learning as ml
from candlewick.plans.backtests import T39
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, W, ctes, decay, lag, rnd
from candlewick.sources.market import supplier_bars, table


def excluded(spark, d):
    """Suppliers in debt are left out."""
    return table(spark, d, "supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_suppkey").cast("string").alias("symbol"))


def points(spark, d):
    return ml.risk_return_features(supplier_bars(spark, d), excluded(spark, d))


Q = {"bars": SUPPLIER, "pr": f"""SELECT symbol, 100 * (close / nullif({lag('close')}, 0) - 1) AS r FROM bars
    WHERE symbol NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)""",
     "q": "SELECT symbol, stddev_pop(r) AS risk, avg(r) AS mean_return, stddev_samp(r) AS sample_risk FROM pr GROUP BY symbol"}
register("Q1_risk_return_features", lambda spark, d: rounded(points(spark, d)), ctes(f"SELECT symbol, {rnd('risk mean_return sample_risk')} FROM q", **Q))
register("Q2_kmeans", lambda spark, d: rounded(ml.kmeans(points(spark, d), 4)))
register("Q3_elbow", lambda spark, d: rounded(ml.elbow(points(spark, d), 29)))
register("Q4_best_per_cluster", lambda spark, d: rounded(ml.best_per_cluster(ml.kmeans(points(spark, d), 4))))
for _c in ("mean_return", "risk"):
    register(f"Q5_top_by_{_c}", lambda spark, d, c=_c: rounded(ml.top_by(points(spark, d), c)), ctes(
        f"SELECT symbol, {rnd(_c)} FROM (SELECT * FROM q ORDER BY {_c} DESC, symbol LIMIT 5)", **Q))

LAB = {**T39, "lab": f"""SELECT *, CASE WHEN ts < cx AND cg >= 0 THEN 'buy' ELSE 'stop' END AS label FROM (
    SELECT b.*, f.above, last_value(t.exit_ts IGNORE NULLS) OVER w AS cx, last_value(t.gain IGNORE NULLS) OVER w AS cg FROM bars b JOIN fl f USING (symbol, ts)
    LEFT JOIN tr t ON t.symbol = b.symbol AND t.entry_ts = b.ts WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts))""",
       "rg": "SELECT symbol, ts, greatest(open, high, low, close) - least(open, high, low, close) AS x FROM bars",
       **decay("rg", "x", com=14, name="atr"),
       "ff": "SELECT symbol, ts, close, label, above, atr, volume FROM lab JOIN v_atr USING (symbol, ts)",
       "ts8": f"SELECT *, CASE WHEN row_number() OVER {W} <= floor(count(*) OVER (PARTITION BY symbol) * 0.8) THEN 'train' ELSE 'test' END AS part FROM ff"}
LAB["rg"] = LAB["rg"].replace(" AS x ", " AS rng ")
LAB.update(decay("rg", "rng", com=14, name="atr"))


def labelled(spark, d):
    return ml.label_winning_trades(supplier_bars(spark, d))


def split(spark, d):
    return ml.time_split(ml.feature_frame(labelled(spark, d)))


register("R1_label_winning_trades", lambda spark, d: labelled(spark, d).select("symbol", "ts", "label"), ctes(
    "SELECT symbol, ts, label FROM lab", bars=SUPPLIER, **LAB))
register("R2_feature_frame", lambda spark, d: rounded(ml.feature_frame(labelled(spark, d)), keep=("close",)), ctes(
    f"SELECT symbol, ts, close, label, above, {rnd('atr volume')} FROM ff", bars=SUPPLIER, **LAB))
register("R3_time_split", lambda spark, d: split(spark, d).select("symbol", "ts", "part"), ctes(
    "SELECT symbol, ts, part FROM ts8", bars=SUPPLIER, **LAB))
#: As many as the reference fits.
TREES = 10_000
register("R4_decision_tree", lambda spark, d: ml.classify(split(spark, d)))
register("R5_random_forest", lambda spark, d: ml.classify(split(spark, d), "forest", trees=TREES))


def baseline(spark, d):
    """The cross flag itself as the prediction, on the test rows: what the metrics can be checked on exactly."""
    return split(spark, d).filter("part = 'test'").withColumn("predicted", F.when(F.col("above") == 1, "buy").otherwise("stop"))


CM = "count_if(label = '{k}' AND p = '{k}')"


def _class(k: str) -> str:
    tp, fp, fn = (f"count_if({c})" for c in (f"label = '{k}' AND p = '{k}'", f"label <> '{k}' AND p = '{k}'", f"label = '{k}' AND p <> '{k}'"))
    acc = "count_if(label = p) / CAST(count(*) AS DOUBLE)"
    return (f"SELECT '{k}' AS class, round({tp} / CAST(nullif({tp} + {fp}, 0) AS DOUBLE) + 1e-9, 6) AS precision, round({tp} / CAST(nullif({tp} + {fn}, 0) AS DOUBLE) + 1e-9, 6) AS recall, "
            f"round(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0) + 1e-9, 6) AS f1, {tp} + {fn} AS support, round({acc} + 1e-9, 6) AS accuracy, round(1 - {acc} + 1e-9, 6) AS error FROM pd")


PD = {**LAB, "pd": "SELECT *, CASE WHEN above = 1 THEN 'buy' ELSE 'stop' END AS p FROM ts8 WHERE part = 'test'"}
register("R6_classification_metrics", lambda spark, d: rounded(ml.classification_metrics(baseline(spark, d))), ctes(
    f"{_class('buy')} UNION ALL {_class('stop')}", bars=SUPPLIER, **PD))
register("R6_confusion_matrix", lambda spark, d: ml.confusion(baseline(spark, d)), ctes(
    "SELECT label, p AS predicted, count(*) AS rows FROM pd GROUP BY label, p", bars=SUPPLIER, **PD))
register("R6_tree_metrics", lambda spark, d: rounded(ml.classification_metrics(ml.classify(split(spark, d)))))
register("R7_replay_predictions", lambda spark, d: rounded(ml.replay(ml.classify(split(spark, d), "forest", trees=TREES, balanced=True))))
register("R7_replay_baseline", lambda spark, d: rounded(ml.replay(baseline(spark, d), "above")), ctes(
    """SELECT symbol, count(*) AS trades, round(avg((gain > 0)::INT) + 1e-9, 6) AS hit_rate, round(avg(gain) + 1e-9, 6) AS payoff, round(sum(gain) + 1e-9, 6) AS total,
    CAST(sum(date_diff('day', ets, ts)) AS BIGINT) AS exposure_days FROM (SELECT symbol, ts, ets, tn, pt, close - ep AS gain FROM (
    SELECT *, lag(ts) OVER w AS ets, lag(close) OVER w AS ep, lag(tn) OVER w AS pt FROM (SELECT * FROM (SELECT *, above - lag(above) OVER (PARTITION BY symbol ORDER BY ts) AS tn FROM pd) WHERE tn <> 0)
    WINDOW w AS (PARTITION BY symbol ORDER BY ts))) WHERE tn = -1 AND pt = 1 GROUP BY symbol""", bars=SUPPLIER, **PD))
