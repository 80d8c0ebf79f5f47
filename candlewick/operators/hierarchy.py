"""Hierarchical risk parity: assets are ordered along a tree of their correlations and weights are split down the order.

The tree is the minimum spanning tree of the correlation distance, found by Boruvka's rounds over the stored pairs: every component takes its
shortest way out, components merge, pairs inside a component are dropped. Only the tree's edges, one fewer than assets, meet in one task per
universe, to be put in order. Variances of all halves of all levels come from one aggregate over the pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.tables import stored

#: Halvings of an order, at most: more than the logarithm of any number of assets.
LEVELS = 40


def distances(cov: DataFrame) -> DataFrame:
    """(universe, a, b, w) for each pair a < b of half-stored (universe, asset_i, asset_j, cov): the root of half of what the correlation lacks to 1."""
    own = cov.filter("asset_i = asset_j and cov > 0").select("universe", "asset_i", F.sqrt("cov").alias("s"))
    pairs = cov.filter("asset_i < asset_j").join(own.withColumnRenamed("s", "si"), ["universe", "asset_i"]).join(
        own.select("universe", F.col("asset_i").alias("asset_j"), F.col("s").alias("sj")), ["universe", "asset_j"])
    corr = F.col("cov") / (F.col("si") * F.col("sj"))
    return pairs.select("universe", F.col("asset_i").alias("a"), F.col("asset_j").alias("b"), F.sqrt(F.greatest((1 - corr) / 2, F.lit(0.0))).alias("w"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """The edges (universe, a, b, w) of each universe's minimum spanning tree, or forest; of equal ones that first by (a, b). edges: each pair once, a < b."""
    open_ = stored(edges.select("universe", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "tree-pairs")
    tree = []
    while not open_.isEmpty():
        way = F.struct("w", "a", "b")
        out = open_.select("universe", F.col("ca").alias("c"), F.col("cb").alias("to"), way.alias("way")).unionByName(
            open_.select("universe", F.col("cb").alias("c"), F.col("ca").alias("to"), way.alias("way")))
        best = stored(out.groupBy("universe", "c").agg(F.min(F.struct("way", "to")).alias("m")).select("universe", "c", "m.way", "m.to"), "tree-ways")
        tree.append(best.select("universe", "way.a", "way.b", "way.w").distinct())
        # ways form trees with one pair of components that chose each other: the smaller one is the root
        back = best.select("universe", F.col("c").alias("to"), F.col("to").alias("back"))
        hops = stored(best.join(back, ["universe", "to"]).select("universe", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c"))
                                                                 .otherwise(F.col("to")).alias("to")), "tree-hops")
        while True:
            further = hops.select("universe", F.col("c").alias("to"), F.col("to").alias("next"))
            step = stored(hops.join(further, ["universe", "to"]).select("universe", "c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "tree-hops")
            hops = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        for side in ("ca", "cb"):
            open_ = open_.join(hops.select("universe", F.col("c").alias(side), F.col("to").alias(f"{side}_root")), ["universe", side]).drop(side).withColumnRenamed(f"{side}_root", side)
        open_ = stored(open_.select("universe", "a", "b", "w", "ca", "cb").filter("ca <> cb"), "tree-pairs")
    whole = tree[0] if tree else edges.select("universe", "a", "b", "w").limit(0)
    for more in tree[1:]:
        whole = whole.unionByName(more)
    return stored(whole.distinct(), "tree")


def ordered(edges: pd.DataFrame) -> list[str]:
    """Assets of a tree in the order of its merges, nearest first; of two merged clusters that with the smallest name stands first."""
    members: dict[str, list[str]] = {}
    holder: dict[str, str] = {}

    def find(x: str) -> str:
        while holder.setdefault(x, x) != x:
            holder[x] = holder[holder[x]]
            x = holder[x]
        return x

    for a, b in zip(*(edges.sort_values(["w", "a", "b"])[c] for c in ("a", "b")), strict=True):
        one, other = sorted((find(a), find(b)))
        # the holder of a cluster is its smallest name
        members[one] = members.get(one, [one]) + members.pop(other, [other])
        holder[other] = one
    return [x for name in sorted(members) for x in members[name]]


def tree_order(tree: DataFrame) -> DataFrame:
    """(universe, symbol, at): places from 0."""
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        names = ordered(frame)
        return pd.DataFrame({"universe": frame["universe"].iat[0], "symbol": names, "at": range(len(names))})

    return tree.groupBy("universe").applyInPandas(work, "universe string, symbol string, at int")


def _halves(at, n):
    """The stretches (lo, hi) of an order of n that hold a place, from the whole down to the place alone."""
    def halve(have, _):
        lo, hi = F.element_at(have, -1)["lo"], F.element_at(have, -1)["hi"]
        middle = (lo + F.floor((hi - lo) / 2)).cast("int")
        half = F.when(at < middle, F.struct(lo.alias("lo"), middle.alias("hi"))).otherwise(F.struct(middle.alias("lo"), hi.alias("hi")))
        return F.when(hi - lo > 1, F.concat(have, F.array(half))).otherwise(have)

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"))), halve)


def parity_weights(cov: DataFrame) -> DataFrame:
    """(universe, symbol, at, weight) for half-stored (universe, asset_i, asset_j, cov); weights of a universe sum to 1.

    Each stretch of the order is halved, and its weight goes to the halves in inverse proportion to their variance under inverse-variance
    weights. Assets without variance are left out; a universe of one asset gives it all.
    """
    cov = stored(cov.select(F.col("universe").cast("string").alias("universe"), "asset_i", "asset_j", "cov"), "hierarchy-pairs")
    own = cov.filter("asset_i = asset_j and cov > 0").select("universe", F.col("asset_i").alias("symbol"), F.col("cov").alias("var"))
    placed = own.join(tree_order(spanning_tree(distances(cov))), ["universe", "symbol"], "left").withColumn("at", F.coalesce("at", F.lit(0)))
    sizes = placed.groupBy("universe").agg(F.count(F.lit(1)).alias("n"))
    assets = stored(placed.join(sizes, "universe").withColumn("halves", _halves(F.col("at"), F.col("n"))), "hierarchy-order")
    side = lambda name: assets.select("universe", F.col("symbol").alias(f"asset_{name}"), F.col("var").alias(f"v{name}"), F.col("halves").alias(f"h{name}"))
    pairs = cov.join(side("i"), ["universe", "asset_i"]).join(side("j"), ["universe", "asset_j"])
    # stretches that hold both are those from the whole down to where the two part
    together = F.filter("hi", lambda x: F.array_contains("hj", x))
    share = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0) * F.col("cov") / (F.col("vi") * F.col("vj"))
    inverse = F.when(F.col("asset_i") == F.col("asset_j"), 1 / F.col("vi")).otherwise(0.0)
    variances = pairs.select("universe", share.alias("x"), inverse.alias("y"), F.inline(together)).groupBy("universe", "lo", "hi").agg(
        (F.sum("x") / (F.sum("y") * F.sum("y"))).alias("variance"))
    steps = assets.select("universe", "symbol", "at", F.explode(F.zip_with("halves", F.slice(F.col("halves"), 2, LEVELS), lambda a, b: F.struct(a.alias("over"), b.alias("half")))).alias("s"))
    halves = steps.filter("s.half is not null").select("universe", "s.over", "s.half").distinct().select("universe", "over", "half.lo", "half.hi")
    known = halves.join(variances, ["universe", "lo", "hi"])
    both = known.groupBy("universe", "over").agg(F.sum("variance").alias("both"))
    parts = known.join(both, ["universe", "over"]).select("universe", F.struct("lo", "hi").alias("half"), F.log(1 - F.col("variance") / F.col("both")).alias("log"))
    logs = steps.filter("s.half is not null").select("universe", "symbol", F.col("s.half").alias("half")).join(parts, ["universe", "half"]).groupBy("universe", "symbol").agg(F.sum("log").alias("log"))
    return assets.join(logs, ["universe", "symbol"], "left").select("universe", "symbol", "at", F.exp(F.coalesce("log", F.lit(0.0))).alias("weight"))
