"""URL filtering: stated host and path rules first, then association rules mined by FP-growth from labelled urls.

Built-in expressions and Spark's own FP-growth throughout.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TARGET = "=block"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and for no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def stated(rules: dict[str, str]) -> Column:
    """The longest rule (host, then path from the first /) that fits columns host and path; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: each label of the host, words of the path that are no numbers, names in the query."""
    labels = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.filter(F.split("path", r"[/._\-]+"), lambda x: ~x.rlike(r"^\d*$")), lambda x: F.concat(F.lit("path:"), x))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.concat(labels, words, names))


def unruled(rules: dict[str, str]) -> Column:
    """The tokens that no stated rule is made of: with those, combinations would only repeat the rules on urls that they don't fit."""
    used = {f"host:{x}" for r in rules for x in r.partition("/")[0].split(".")} | {f"path:{x}" for r in rules for x in r.partition("/")[2].split("/")}
    return F.filter("tokens", lambda t: ~t.isin(*sorted(used)))


def mined(labelled: DataFrame, support: float = 0.01, confidence: float = 0.95) -> DataFrame:
    """(rule, token, size): an inverted index of token combinations that foretell blocking.

    labelled: tokens (array), bad (boolean). A combination stays if its rule has the support and the confidence and no part of it does
    alone. No rows give no rules.
    """
    baskets = labelled.filter("bad is not null").select(F.when(F.col("bad"), F.array_append("tokens", F.lit(TARGET))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.array_contains("consequent", TARGET)).select(F.array_sort("antecedent").alias("items"))
    found = stored(found.withColumn("rule", F.array_join("items", " ")).withColumn("size", F.size("items")), "rules")
    index = found.select("rule", "size", F.explode("items").alias("token"))
    # a rule that holds all tokens of a smaller one never decides anything
    met = index.select("token", F.col("rule").alias("larger"), F.col("size").alias("of")).join(index, "token").filter("of > size")
    spare = met.groupBy("larger", "rule", "size").agg(F.count("*").alias("n")).filter("n = size").select(F.col("larger").alias("rule")).distinct()
    return stored(index.join(spare, "rule", "left_anti").select("rule", "token", "size"), "index")


def judged(pages: DataFrame, rules: dict[str, str], support: float = 0.01, confidence: float = 0.95, id_col: str = "page_id",
           url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages. rules: "host/path" to "block" or "allow"; the longest that fits wins.

    Urls that rules decide are the labels that combinations are mined from; a url without a rule is blocked if a mined combination
    holds in it, else allowed. Null urls have no tokens and are allowed. Repeated rows and null ids are kept.
    """
    split = narrow(pages, page_id=id_col, url=url_col).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    split = split.withColumn("rule", stated(rules)).withColumn("tokens", tokens(F.col("url"))).withColumn("tokens", unruled(rules))
    block = [r for r, verdict in rules.items() if verdict == "block"]
    index = mined(split.filter("rule is not null").select("tokens", F.col("rule").isin(block).alias("bad")), support, confidence)
    open_ = split.filter("rule is null").select("page_id", "url", F.explode("tokens").alias("token"))
    met = open_.join(index.withColumnRenamed("rule", "mined"), "token").groupBy("page_id", "url", "mined", "size").agg(F.countDistinct("token").alias("n"))
    bad = met.filter("n = size").select(F.col("page_id").alias("bad_id"), F.col("url").alias("bad_url")).distinct()
    joined = split.join(bad, F.col("page_id").eqNullSafe(F.col("bad_id")) & F.col("url").eqNullSafe(F.col("bad_url")), "left")
    verdict = F.when(F.col("rule").isin(block), "block").when(F.col("rule").isNotNull(), "allow").when(F.col("bad_url").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
