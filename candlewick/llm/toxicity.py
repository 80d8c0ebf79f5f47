"""Toxicity by weak supervision: voters, a generative model of their accuracies and correlations, and a linear classifier.

Voters look at a text and vote toxic, clean, or not at all. The label model is fitted to the votes alone by expectation-
maximisation; its posterior probabilities are what the classifier learns from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import linear
from candlewick.llm.shared import slices

#: Common insults. Fixed values.
INSULTS = ("idiot", "moron", "stupid", "dumb", "pathetic", "worthless", "disgusting", "trash", "garbage", "scum", "loser", "clown", "fool",
           "imbecile", "filth", "vermin", "ugly", "shut up", "drop dead", "hate you")
TOXIC, CLEAN, SILENT = 0, 1, 2
WORD = "[a-z0-9\x80-\U0010ffff]+"


def mined(sample: DataFrame, support: int = 4, odds: float = 12.0, share: float = 0.01) -> list[str]:
    """Words, and beginnings of five and seven letters with a star, of a labelled sample.

    At least `support` toxic texts and `share` of them have each, at `odds` times the clean rate or more.
    """
    sizes = sample.agg(F.count_if(F.col("target") >= 0.5).alias("toxic"), F.count_if(F.col("target") < 0.5).alias("clean")).first()
    if not sizes["toxic"] or not sizes["clean"]:
        return []
    words = sample.select("target", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), 1)).alias("words"))
    begun = [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in (5, 7)]
    words = words.select("target", F.explode(F.array_union("words", F.array_union(*begun))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if(F.col("target") >= 0.5).alias("toxic"), F.count_if(F.col("target") < 0.5).alias("clean"))
    rate = (F.col("toxic") / sizes["toxic"]) / ((F.col("clean") + 1) / sizes["clean"])
    kept = counts.filter((F.col("toxic") >= max(support, share * sizes["toxic"])) & (rate >= odds))
    return sorted(r["word"] for r in kept.select("word").toLocalIterator())


def voters(lexicon: list[str], parts: int = 8) -> list[tuple[re.Pattern, int, int]]:
    """(expression, vote where it is found, vote where not): `parts` shares of the lexicon, the insults, and patterns."""
    spell = lambda word: re.escape(word.removesuffix("*")) + r"\w*" * word.endswith("*")
    either = lambda words: "|".join(map(spell, sorted(words, key=lambda w: (-len(w), w)))) or r"(?!)"
    whole = lambda inner: re.compile(rf"\b(?:{inner})\b", re.I)
    known = either({*lexicon, *INSULTS})
    return [*[(whole(either([w for w in lexicon if crc32(w.encode()) % parts == k])), TOXIC, SILENT) for k in range(parts)],
            (whole(either(INSULTS)), TOXIC, SILENT),
            (whole(known), TOXIC, CLEAN),
            (re.compile(rf"\b(?:{known})\b.{{1,400}}?\b(?:{known})\b", re.I | re.S), TOXIC, SILENT),
            (re.compile(rf"\b(?:you|your|this is)\W+(?:\w+\W+){{0,3}}(?:{known})\b", re.I), TOXIC, SILENT)]


def votes(texts: list[str], judges: list[tuple[re.Pattern, int, int]]) -> np.ndarray:
    return np.array([[yes if rule.search(text) else no for rule, yes, no in judges] for text in texts], np.int8).reshape(-1, len(judges))


def label_model(cast: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """Probability that each row is toxic. cast: a vote of each voter for each row.

    Each voter has a table P(vote | class), estimated by expectation-maximisation from a start where votes mostly hold. Voters that vote
    together more than the classes explain count less: the weight of each is one over one plus its excess correlations.
    """
    if not len(cast):
        return np.zeros(0)
    patterns, back, times = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    said = (patterns == TOXIC).sum(1) - 0.5 * (patterns == CLEAN).sum(1)
    post = np.where(said > 0, 0.9, min(prior, 0.1))
    weight = np.ones(patterns.shape[1])
    for _ in range(rounds):
        both = np.stack([post, 1 - post]) * times  # class by pattern
        table = (np.einsum("cp,pjv->cjv", both, hot) + 0.1) / (both.sum(1)[:, None, None] + 0.3)
        rate = np.clip(both[0].sum() / times.sum(), 0.001, 0.999)
        residual = hot[:, :, TOXIC] - np.einsum("cp,cj->pj", np.stack([post, 1 - post]), table[:, :, TOXIC])
        cov = (residual * times[:, None]).T @ residual / times.sum()
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        linked = np.clip(cov / spread[:, None] / spread, 0, 1)
        np.fill_diagonal(linked, 0)
        weight = 1 / (1 + np.where(linked > 0.1, linked, 0).sum(1))
        gain = np.einsum("pjv,jv->pj", hot, np.log(table[0] / table[1])) @ weight
        post = 1 / (1 + np.exp(-np.clip(np.log(rate / (1 - rate)) + gain, -30, 30)))
    return post[back.ravel()]


#: Words and their beginnings; looks play no part.
SETTINGS = linear.Settings(alpha=1.0, l1=3.0, l2=0.0, looks=0, grams=1, stems=(5, 7), passes=12)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, how: linear.Settings = SETTINGS) -> np.ndarray:
    """Weights of the classifier. Labels pick the lexicon and the prior, on about how.bound rows of the learning folds, at most."""
    sample = linear.labelled(docs, labels, label, folds, held, how.bound)
    judges = voters(mined(sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", linear.AT_ONCE):
            cast = votes(batch.column(1).to_pylist(), judges)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(cast), pa.list_(pa.int8()))], ["doc_id", "target", "votes"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "target").mapInArrow(work, f"doc_id {kind}, target double, votes array<tinyint>").toArrow().sort_by("doc_id")
    cast = np.array(rows["votes"].to_pylist(), np.int8).reshape(-1, len(judges))
    targets = np.asarray(rows["target"])
    posterior = label_model(cast, float(targets.mean()) if len(targets) else 0.5)
    found, _ = linear.gathered(sample, how)
    return linear.train(found, posterior, how)


def accepted(docs: DataFrame, weights: np.ndarray, how: linear.Settings = SETTINGS, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, every column as it was."""
    name = "toxicity_" + "x" * max(map(len, docs.columns))  # longer than any column there
    return linear.scored(docs, weights, how, text_col, name).filter(F.col(name) < threshold).select(*docs.columns)
