"""Clustering of assets by risk and return, and classification of trade rows, with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.decay import ewm_mean
from candlewick.functions.guards import div
from candlewick.functions.tables import stored
from candlewick.functions.windows import over
from candlewick.operators.backtest import cross_flags, round_trips, trade_metrics
from candlewick.operators.forest import forest
from candlewick.operators.indicators import rsi_momentum

FEATURES = ("above", "atr", "volume")
#: Fits that share the cluster at a time.
AT_ONCE = 4


def risk_return_features(bars: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Population deviation and mean of percent returns per asset, without the excluded ones."""
    kept = bars if excluded is None else bars.join(excluded.select("symbol"), "symbol", "left_anti")
    r = kept.withColumn("_r", 100 * over(kept).change("close"))
    return r.groupBy("symbol").agg(F.stddev_pop("_r").alias("risk"), F.avg("_r").alias("mean_return"),
                                   F.stddev_samp("_r").alias("sample_risk")).dropna()


def _vectors(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def kmeans(features: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Cluster of each asset and the cluster centre."""
    data = _vectors(features, ("risk", "mean_return"))
    model = KMeans(k=k, seed=seed).fit(data)
    centres = model.clusterCenters()
    at = lambda i: F.create_map(*[x for c, v in enumerate(centres) for x in (F.lit(c), F.lit(float(v[i])))])[F.col("cluster")]
    out = model.transform(data).withColumnRenamed("prediction", "cluster").drop("features")
    return out.withColumns({"centre_risk": at(0), "centre_return": at(1)})


def elbow(features: DataFrame, largest: int = 29, seed: int = 0) -> DataFrame:
    """Within-cluster sum of squares per k; k = 1 from the variances, the rest from one fit each, a few at a time on the same points."""
    data = _vectors(features, ("risk", "mean_return")).persist()
    one = features.agg(((F.var_pop("risk") + F.var_pop("mean_return")) * F.count(F.lit(1))).alias("cost")).select(
        F.lit(1).alias("k"), "cost")
    with ThreadPoolExecutor(AT_ONCE) as fits:
        costs = list(fits.map(lambda k: (k, float(KMeans(k=k, seed=seed).fit(data).summary.trainingCost)), range(2, largest + 1)))
    data.unpersist()
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("cost")) for k, c in costs])
    return one.unionByName(one.select(F.explode(rows).alias("r")).select("r.*"))


def best_per_cluster(clustered: DataFrame) -> DataFrame:
    """Asset with the highest mean over sample deviation in each cluster."""
    ratio = div("mean_return", "sample_risk")
    return clustered.withColumn("ratio", ratio).groupBy("cluster").agg(
        F.max_by("symbol", F.struct("ratio", "symbol")).alias("symbol"), F.max("ratio").alias("ratio"), F.count(F.lit(1)).alias("members"))


def top_by(features: DataFrame, column: str, n: int = 5) -> DataFrame:
    return features.orderBy(F.desc_nulls_last(column), "symbol").limit(n).select("symbol", column)


def label_winning_trades(bars: DataFrame, fast: int = 3, slow: int = 9) -> DataFrame:
    """`buy` on rows inside a trade (entry <= ts < exit) that did not lose, else `stop`.

    Flags alternate, so a row is inside a trade if its last turn was a buy, and the next sell ends that trade: both are carried along
    the rows, forward and back, and the bars are neither read twice nor joined.
    """
    flags = cross_flags(bars, fast, slow)
    s = over(flags)
    back = s.desc.rowsBetween(Window.unboundedPreceding, 0)
    rows = flags.withColumns({"_in": F.last(F.when(F.col("turn") != 0, F.struct("turn", "close")), ignorenulls=True).over(s.running),
                              "_out": F.last(F.when(F.col("turn") == -1, F.struct("close")), ignorenulls=True).over(back)})
    inside = (F.col("_in.turn") == 1) & (F.col("_out.close") - F.col("_in.close") >= 0)
    return rows.withColumn("label", F.when(F.coalesce(inside, F.lit(False)), "buy").otherwise("stop")).drop("_in", "_out")


def feature_frame(labelled: DataFrame, extended: bool = False) -> DataFrame:
    """Cross flag, decayed range and volume (optionally 3-bar deviation and momentum index), rows with NULLs dropped."""
    out = labelled.withColumn("_range", F.greatest("open", "high", "low", "close") - F.least("open", "high", "low", "close"))
    out = ewm_mean(out, "_range", "atr", com=14).drop("_range")
    names = list(FEATURES)
    if extended:
        out = rsi_momentum(out.withColumn("std3", over(out).std("close", 3)))
        names += ["std3", "rsi_momentum"]
    return out.select("symbol", "ts", "close", "label", *names).dropna()


def time_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """`train` for the leading share of each symbol's rows in time order, never at random."""
    s = over(df)
    rows = df.withColumns({"_i": s.position(), "_n": F.count(F.lit(1)).over(s.all)})
    return rows.withColumn("part", F.when(F.col("_i") <= F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_i", "_n")


def classify(split: DataFrame, model: str = "tree", features: tuple[str, ...] = FEATURES, depth: int | None = None, trees: int = 100,
             seed: int = 0, balanced: bool = False) -> DataFrame:
    """Fit on the training part with entropy splits and predict the test part: (symbol, ts, close, label, above, predicted).

    `balanced` weighs the rows so that both classes count the same. A fit reads its rows several times, so the split is stored first.
    """
    split = stored(split.select("symbol", "ts", "close", "label", "part", *dict.fromkeys(("above", *features))), "split")
    if model == "forest":
        return forest(split, features, trees, depth or 10, seed, balanced).select("symbol", "ts", "close", "label", "above", "predicted")
    data = _vectors(split.withColumn("y", (F.col("label") == "buy").cast("double")), features)
    share = data.filter("part = 'train'").agg(F.avg("y"))
    weight = F.when(F.col("y") == 1, 1 - share.scalar()).otherwise(share.scalar()) if balanced else F.lit(1.0)
    data = data.withColumn("w", weight)
    learner = DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="w", impurity="entropy", maxDepth=depth or 3, seed=seed)
    fitted = learner.fit(data.filter("part = 'train'"))
    out = fitted.transform(data.filter("part = 'test'"))
    return out.select("symbol", "ts", "close", "label", "above", F.when(F.col("prediction") == 1, "buy").otherwise("stop").alias("predicted"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("rows"))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with overall accuracy and error."""
    c = confusion(predictions).persist()  # four rows at most, read three times
    n, ok = F.sum("rows"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("rows")).otherwise(0))
    overall = c.agg(F.struct(div(ok, n).alias("accuracy"), (1 - div(ok, n)).alias("error")).alias("o"))
    per = []
    for k in ("buy", "stop"):
        hit = lambda a, b: F.sum(F.when(a & b, F.col("rows")).otherwise(0))
        is_l, is_p = F.col("label") == k, F.col("predicted") == k
        tp, fp, fn = hit(is_l, is_p), hit(~is_l, is_p), hit(is_l, ~is_p)
        per.append(c.agg(F.lit(k).alias("class"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
                         div(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")))
    o = overall.scalar()
    return reduce(DataFrame.unionByName, per).withColumns({"accuracy": o["accuracy"], "error": o["error"]})


def replay(predictions: DataFrame, by: str = "predicted") -> DataFrame:
    """Trades from flips of the predicted class (or of the raw cross flag for the baseline) and their metrics per symbol."""
    held = (F.col("predicted") == "buy").cast("int") if by == "predicted" else F.col("above")
    flags = predictions.withColumn("_h", held)
    return trade_metrics(round_trips(flags.withColumn("turn", over(flags).diff("_h"))))
