"""Text rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate their votes are, a posterior decides.

Built-in expressions throughout; each step of the estimation is one aggregate over the distinct vote patterns. Labels are used nowhere. Every rule can
fail alone, on a text of any length; rules that see the same fault are one rule, since they would count it twice; silence has no weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, stored

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
GOOD, BAD, SILENT = 1, -1, 0
#: A mark that ends a sentence, and what may follow it.
ENDED = r"[.!?\x{2026}\x{3002}:;][\x22\x27\x{2019}\x{201D}\x{BB})\]]*[\x20\x09-\x0D]*$"


def _repeat_words() -> Column:
    """Words covered by 3-word windows found twice or more, from the sorted starts of such windows in `again`."""
    gap = lambda p, i: F.least(F.lit(3), F.coalesce(F.get("again", i + 1) - p, F.lit(3)))
    return F.aggregate(F.transform("again", gap), F.lit(0).cast("long"), lambda total, n: total + n)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_cries, n_lines, n_ended, n_lettered) of each row; null texts
    have no words. n_lines counts lines with a word, n_ended those that end as sentences do, n_lettered words with a letter.

    A text whose 3-word windows all have different hashes has no repeat; only others are sorted and compared word by word.
    """
    text = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    parts = text.select("doc_id", "text", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
                        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    measured = parts.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"), without("!").cast("long").alias("n_cries"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: x.rlike(ENDED))).cast("long").alias("n_ended"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_lettered"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    counts = [c for c in measured.columns if c not in ("words", "codes")]
    starts = F.when(F.col("n_words") >= 4, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    hashed = measured.select(*counts, "words", F.transform(starts, lambda i: F.xxhash64(F.get("codes", i), F.get("codes", i + 1), F.get("codes", i + 2))).alias("keys"))
    window = lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("p"))
    repeats = F.size(F.array_distinct("keys")) < F.size("keys")
    ordered = hashed.select(*counts, F.when(repeats, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("keys") - 1), window))).alias("ordered"))
    same = lambda x, i: (F.get("ordered", i - 1)["w"] == x["w"]) | (F.get("ordered", i + 1)["w"] == x["w"])
    again = ordered.select(*counts, F.when(F.col("ordered").isNotNull(), F.sort_array(F.transform(
        F.filter("ordered", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))).alias("again"))
    return again.select(*counts, F.coalesce(_repeat_words(), F.lit(0)).cast("long").alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """A vote of each rule: 1 good, -1 bad, 0 none."""
    per = lambda c, of: F.col(c) / F.greatest(F.col(of), F.lit(1))
    vote = lambda bad, good: F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(SILENT))
    some, mean, marks = F.col("n_words") >= 10, per("word_chars", "n_words"), per("n_symbols", "n_words")
    ended, lettered = per("n_ended", "n_lines"), per("n_lettered", "n_words")
    repeated = per("n_repeat_words", "n_words")
    return {"length": vote(F.col("n_words") < 20, F.col("n_words") >= 50),
            "word_size": vote((mean < 3) | (mean > 12), mean.between(4, 8)),
            "symbols": vote(marks > 0.1, some & (marks < 0.01)),
            "repetition": vote((repeated > 0.4) | (F.col("n_dup_lines") > 0.3 * F.col("n_lines")), some & (repeated < 0.1) & (F.col("n_dup_lines") == 0)),
            "shouting": vote((F.col("n_capitals") > 0.3 * F.col("word_chars")) | (F.col("n_cries") > 0.2 * F.col("n_words")),
                             some & (F.col("n_capitals") < 0.15 * F.col("word_chars")) & (F.col("n_cries") < 0.1 * F.col("n_words"))),
            "line_ends": vote(some & (ended < 0.9), some & (ended >= 0.95)),
            "letters": vote(lettered < 0.8, some & (lettered > 0.95))}


def label_model(votes: DataFrame, names: list[str], rounds: int = 25) -> tuple[float, dict[str, dict[int, float]]]:
    """(log odds of good, log odds that each vote of each rule adds), by expectation-maximisation over all rows.

    votes: one column per rule. A rule's accuracy is that of the votes it casts; silence adds nothing. At first a text is good by as much as
    nothing speaks against it. Only distinct patterns, 3 to the number of rules at most, are iterated on, and only a table of
    estimates comes to the driver. An empty table leaves even odds, and votes add nothing.
    """
    patterns = stored(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    against = sum((F.when(F.col(c) == BAD, 1).otherwise(0) for c in names), F.lit(0))
    posterior = F.when(against == 0, F.lit(0.95)).when(against == 1, F.lit(0.4)).otherwise(F.lit(0.05))
    base, gain = 0.0, {c: dict.fromkeys((GOOD, BAD), 0.0) for c in names}
    for _ in range(rounds):
        soft = patterns.withColumn("good", F.col("n") * posterior).withColumn("bad", F.col("n") * (1 - posterior))
        sums = soft.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), *[
            F.sum(F.when(F.col(c) == v, F.col(side)).otherwise(0.0)).alias(f"{c}:{v}:{side}") for c in names for v in (GOOD, BAD) for side in ("good", "bad")]).first()
        if sums["good"] is None:
            break
        base = math.log((sums["good"] + 1) / (sums["bad"] + 1))
        for c in names:
            cast = {side: sums[f"{c}:{GOOD}:{side}"] + sums[f"{c}:{BAD}:{side}"] for side in ("good", "bad")}
            gain[c] = {v: math.log((sums[f"{c}:{v}:good"] + 0.5) / (cast["good"] + 1)) - math.log((sums[f"{c}:{v}:bad"] + 0.5) / (cast["bad"] + 1)) for v in (GOOD, BAD)}
        posterior = probability(base, gain)
    return base, gain


def probability(base: float, gain: dict[str, dict[int, float]]) -> Column:
    """Posterior probability of good quality from the vote columns."""
    odds = F.lit(base)
    for c, added in gain.items():
        odds = odds + F.when(F.col(c) == GOOD, added[GOOD]).when(F.col(c) == BAD, added[BAD]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes and the posterior `good` of each row of docs. Null and repeated rows are kept; a null text counts as empty."""
    measured = stored(statistics(docs, id_col, text_col), "statistics")
    made = rules()
    votes = measured.select("*", *[vote.alias(name) for name, vote in made.items()])
    base, gain = label_model(votes, list(made))
    return votes.withColumn("good", probability(base, gain))
