"""Hashed word n-grams and a logistic regression on them, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import learning_fold, narrow, sampled, slices, stored
from candlewick.llm.words import MARKS, Words, mix, runs

#: Features are numbered below this; number 0 is the constant.
SPACE = 1 << 20
#: Bytes of text whose features are made at once; they take some fifty times as much memory for a while.
AT_ONCE = 1 << 18
CLASSES = np.zeros((4, 256), np.int32)  # capital, digit, mark, symbol
CLASSES[0, 0x41:0x5B] = CLASSES[1, 0x30:0x3A] = 1
CLASSES[2] = MARKS
CLASSES[3, list(b"#*$%&|<>")] = 1


def _inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs of n words that stay in one text, and the text of each."""
    sizes = np.maximum(np.diff(first) - n + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(sizes.sum()) + np.repeat(first[:-1] - (np.cumsum(sizes) - sizes), sizes), owner


def shapes(words: Words) -> np.ndarray:
    """What each word looks like: capitals, digits, marks and symbols, its last byte, and its length."""
    size = words.ends - words.starts
    if not len(size):
        return np.zeros(0, np.int64)
    caps, digits, marks, symbols = (np.concatenate([[0], np.cumsum(c[words.data])]) for c in CLASSES)
    count = lambda sums: sums[words.ends] - sums[words.starts]
    last = words.data[words.ends - 1]
    return ((count(caps) > 0) * 1 + (count(caps) >= np.maximum(2, size - count(marks))) * 2 + (count(digits) > 0) * 4 + (count(symbols) > 0) * 8
            + (last == ord("!")) * 16 + (count(marks) == size) * 32 + (count(marks) > 1) * 64 + np.minimum(size // 3, 4) * 128).astype(np.int64)


def features(texts: pa.Array, grams: int = 2, looks: int = 3, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct feature of each text, by text.

    Lower-cased words without marks, in runs of 1 to `grams`; the looks of words in runs of 1 to `looks`, and how common each look is
    in the text; the first bytes of longer words, `stems` many; the order of magnitude of the word count. Texts without words have that last one alone.
    """
    plain, raw = Words(texts, lower=True, blank=MARKS), Words(texts)
    look, counts = shapes(raw), np.diff(raw.first)
    found = [np.arange(len(counts)) * SPACE, np.arange(len(counts)) * SPACE + 1 + np.log2(counts + 1).astype(np.int64)]

    def add(owner: np.ndarray, hashes: np.ndarray) -> None:
        found.append(owner * SPACE + 64 + (hashes % np.uint64(SPACE - 64)).astype(np.int64))

    for source, first, most, salt in ((plain.hashes(), plain.first, grams, 0), (mix(look.astype(np.uint64) + np.uint64(1)), raw.first, looks, 16)):
        for n in range(1, most + 1):
            at, owner = _inside(first, n)
            if len(at):
                add(owner, runs(source, n, salt + n)[at])
    size = plain.ends - plain.starts
    for n in stems:
        longer = np.flatnonzero(size > n)
        if len(longer):
            add(plain.owners()[longer], runs(plain.prefixes(n)[longer], 1, 32 + n))
    if looks and len(look):
        pairs, times = np.unique(raw.owners() * 1024 + look, return_counts=True)
        share = np.floor(np.log2(times / counts[pairs // 1024])).clip(-7, 0).astype(np.int64)
        add(pairs // 1024, mix(((pairs % 1024) * 8 - share + (1 << 30)).astype(np.uint64)))
    both = np.unique(np.concatenate(found))
    return both // SPACE, both % SPACE


@dataclass(frozen=True)
class Settings:
    """alpha, beta: learning rate; l1, l2: penalties; passes over the sample; bound: labelled rows learned from, about, at most."""

    alpha: float = 0.05
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    passes: int = 4
    bound: int = 6000
    grams: int = 2
    looks: int = 3
    stems: tuple[int, ...] = ()

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return features(texts, self.grams, self.looks, self.stems)


def train(rows: list[np.ndarray], targets: np.ndarray, how: Settings) -> np.ndarray:
    """Weight of every feature. rows: distinct features of each text; targets: 0 to 1. The order is fixed, so is the result."""
    z, n = np.zeros(SPACE), np.zeros(SPACE)
    order = np.random.default_rng(0)

    def weights(at) -> np.ndarray:
        pull = z[at]
        return np.where(np.abs(pull) <= how.l1, 0.0, (np.sign(pull) * how.l1 - pull) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.passes):
        for k in order.permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - targets[k]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def scores(texts: pa.Array, weights: np.ndarray, how: Settings) -> np.ndarray:
    """Sparse dot product of each text's features with the weights, as a probability."""
    owner, at = how.features(texts)
    total = np.bincount(owner, weights[at], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, text, target): about `bound` labelled rows outside the held-out fold, at most, each text once.

    Null labels and ids are left out; of several labels of an id the mean counts. The choice is by a hash of the id.
    """
    known = narrow(labels, doc_id=id_col, target=label).dropna().filter(learning_fold("doc_id", folds, held))
    known = sampled(known.groupBy("doc_id").agg(F.avg("target").alias("target")), "doc_id", bound)
    found = narrow(docs, doc_id=id_col, text=text_col).join(F.broadcast(known), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    return stored(found.groupBy(F.sha2("text", 256)).agg(F.min_by("doc_id", "doc_id").alias("doc_id"), F.first("text").alias("text"),
                                                         F.avg("target").alias("target")).select("doc_id", "text", "target"), "labelled")


def gathered(sample: DataFrame, how: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and target of each row of a bounded sample, by id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            owner, at = how.features(batch.column(1))
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["doc_id", "target", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "target").mapInArrow(work, f"doc_id {kind}, target double, features array<int>").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    return [np.asarray(x.values) for x in rows["features"]], np.asarray(rows["target"])


def fitted(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, how: Settings = Settings()) -> np.ndarray:
    """Weights learned from labelled rows of the learning folds. No labels give weights of zero: every score is one half."""
    rows, targets = gathered(labelled(docs, labels, label, folds, held, how.bound), how)
    return train(rows, targets, how)


def scored(docs: DataFrame, weights: np.ndarray, how: Settings = Settings(), text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `name`, 0 to 1. Null texts score as empty ones; other columns are carried along; rows with equal text score alike."""
    if name in docs.columns:
        raise ValueError(f"column {name} is there already")
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, AT_ONCE):
            found = scores(batch.column(at), sent.value, how)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    schema = type(docs.schema)(list(docs.schema.fields)).add(name, "double")
    return docs.mapInArrow(work, schema)
