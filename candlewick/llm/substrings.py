"""Repeated passages by seed and extend: winnowed anchors, extended to all windows that they stand for.

A window is `width` consecutive words. Its anchor is the least-hashed seed of `seed` words in it, so equal windows have equal anchors at
equal places, and windows beside each other mostly share one. A stretch is all windows of one anchor. Stretches are joined on anchor
and content: of equal stretches the first stands for all. Where an anchor has stretches of different content, the windows
of the first ones are compared one by one. No pair of documents is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, slices, stored, utf8
from candlewick.llm.words import STEP, Words, mix, runs


class Stretches:
    """Stretches of the texts of a batch: owner (text), lo (first window, from the text's start), anchor, content, size; windows of all in turn."""

    def __init__(self, texts: pa.Array, width: int, seed: int):
        words = Words(texts)
        self.n_words = np.diff(words.first)
        sizes = np.maximum(self.n_words - width + 1, 0)
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(words.first[:-1] - (np.cumsum(sizes) - sizes), sizes)
        if not len(at):
            self.owner = self.lo = self.size = self.begin = np.zeros(0, np.int64)
            self.anchor = self.content = self.windows = np.zeros(0, np.uint64)
            return
        h = words.hashes()
        seeds, self.windows = runs(h, seed, 7), runs(h, width, 9)[at]
        best, place = seeds[at], at.copy()
        for k in range(1, width - seed + 1):
            other = seeds[at + k]
            less = other < best
            best[less] = other[less]
            place[less] = at[less] + k
        self.begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.size = np.diff(np.append(self.begin, len(at)))
        self.owner = of[self.begin]
        self.lo = at[self.begin] - words.first[self.owner]
        self.anchor = best[self.begin]
        step = np.arange(len(at)) - np.repeat(self.begin, self.size)
        self.content = np.add.reduceat(mix(self.windows + step.astype(np.uint64) * STEP), self.begin)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _joined(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """docs with the lists of its id; null ids meet."""
    return docs.join(listed.withColumnRenamed("doc_id", "listed_id"), F.col("doc_id").eqNullSafe(F.col("listed_id")), how).drop("listed_id")


def deduplicated(docs: DataFrame, width: int = 20, seed: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text without every word covered by a window that also starts earlier.

    Earlier is in a row of smaller id, or before in the same row. Null texts have no words; a null id is smaller than all others. Rows that
    share an id are judged as if each were the only one of that id, against the others.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = Stretches(batch.column(1), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.owner)), pa.array(s.lo, pa.int32()), _long(s.anchor), _long(s.content)],
                                             ["doc_id", "lo", "anchor", "content"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = Stretches(batch.column(1), width, seed)
            chosen = _members(s, batch.column(2))
            size = np.where(chosen, s.size, 0)
            pick = np.flatnonzero(np.repeat(chosen, s.size))
            step = np.arange(len(pick)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(s.owner, size))), pa.array(np.repeat(s.lo, size) + step, pa.int32()),
                                              _long(np.repeat(s.anchor, size)), _long(s.windows[pick])], ["doc_id", "lo", "anchor", "window"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = Stretches(batch.column(1), width, seed)
            keep = np.repeat(_members(s, batch.column(2)), s.size)
            of = np.repeat(s.owner, s.size)
            at = np.repeat(s.lo - s.begin, s.size) + np.arange(len(of))
            drop = ~(keep | _listed(of, at, batch.column(3)))
            first = np.concatenate([[0], np.cumsum(s.n_words)])
            change = np.zeros(first[-1] + 1, np.int64)
            np.add.at(change, first[of[drop]] + at[drop], 1)
            np.add.at(change, first[of[drop]] + at[drop] + width, -1)
            stays = np.cumsum(change[:-1]) == 0
            removed = np.diff(np.concatenate([[0], np.cumsum(~stays)])[first])
            texts = [b" ".join(compress(t.split(), stays[a:b])).decode() for t, a, b in zip(utf8(batch.column(1)), first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    cuts = docs.mapInArrow(cut, f"doc_id {kind}, lo int, anchor long, content long")
    first = F.min(F.struct("doc_id", "lo")).alias("first")
    firsts = stored(cuts.groupBy("anchor", "content").agg(first).select("anchor", "first.*"), "stretches")
    shared = firsts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    open_ = stored(firsts.join(shared, "anchor", "left_semi").select("doc_id", "lo"), "open")
    alone = firsts.join(shared, "anchor", "left_anti").select("doc_id", "lo")
    windows = _joined(docs, open_.groupBy("doc_id").agg(F.collect_list("lo").alias("los")), "inner").mapInArrow(
        extend, f"doc_id {kind}, lo int, anchor long, window long")
    single = windows.groupBy("anchor", "window").agg(first).select("first.*")
    both = alone.select("doc_id", "lo", F.lit(True).alias("all")).union(single.select("doc_id", "lo", F.lit(False)))
    listed = both.groupBy("doc_id").agg(F.collect_list(F.when(F.col("all"), F.col("lo"))).alias("los"), F.collect_list(F.when(~F.col("all"), F.col("lo"))).alias("ones"))
    return _joined(docs, listed, "left").mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept string")


def _listed(owner: np.ndarray, at: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each (text, number) is in the text's list."""
    flat = np.asarray(lists.flatten(), np.int64)
    sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()] if lists.null_count else np.diff(np.asarray(lists.offsets)), np.int64)
    return np.isin(owner << 32 | at, np.repeat(np.arange(len(sizes)), sizes) << 32 | flat)


def _members(s: Stretches, lists: pa.Array) -> np.ndarray:
    return _listed(s.owner, s.lo, lists)
