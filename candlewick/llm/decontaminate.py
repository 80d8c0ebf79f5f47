"""Benchmark decontamination: one automaton over windows of the normalised test items, one scan of each document.

Normalising lower-cases A-Z and leaves words of ASCII letters and digits and of all characters beyond ASCII, one space apart. A
window is `width` consecutive words of an item; an item with fewer words, but not none, is one window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, slices, utf8

#: Bytes of words stay, A-Z in lower case; all others become spaces.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
SCHEMA = "doc_id {}, n_words long, items array<string>, spans array<struct<start:long,end:long,first_word:long,n_words:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(items: list[tuple[str, bytes]], width: int) -> dict[str, list[str]]:
    """The items that each window, with a space before and after, is from."""
    out: dict[str, list[str]] = {}
    for name, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            out.setdefault(f" {b' '.join(words[k:k + width]).decode()} ", []).append(name)
    return out


@lru_cache(1)
def _automaton(items: tuple[tuple[str, bytes], ...], width: int):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, names in windows(items, width).items():
        found.add_word(pattern, (pattern.count(" ") - 1, len(pattern), tuple(set(names))))
    found.make_automaton()
    return found


def scan(text: bytes, automaton) -> tuple[int, set[str], list[tuple[int, int]]]:
    """Number of words, items met, and (first word, number of words) of each merged run of hit words."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), set(), []
    line = f" {b' '.join(words).decode()} "
    hits = list(automaton.iter(line))
    if not hits:
        return len(words), set(), []
    begins = np.array([0, *accumulate(len(w) + 1 for w in line[1:-1].split(" "))])  # where the space before each word is
    runs = [(int(np.searchsorted(begins, end + 1 - length)), n) for end, (n, length, _) in hits]
    return len(words), {name for _, (_, _, names) in hits for name in names}, merged(runs)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words without overlap, in order."""
    out: list[tuple[int, int]] = []
    for first, size in sorted(spans):
        if out and first <= out[-1][0] + out[-1][1]:
            start = out[-1][0]
            out[-1] = (start, max(out[-1][1], first + size - start))
        else:
            out.append((first, size))
    return out


def blocks(items: list[tuple[str, bytes]], most: int) -> list[list[tuple[str, bytes]]]:
    """Items in turn, split so that the texts of a block stay below `most` bytes (a longer item is alone)."""
    out, held = [[]], 0
    for name, text in items:
        if out[-1] and held + len(text) > most:
            out.append([])
            held = 0
        out[-1].append((name, text))
        held += len(text)
    return out


def _sent(benchmark: DataFrame, item_id: str, item_texts: tuple[str, ...], most_bytes: int) -> list:
    """The items as broadcast blocks."""
    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"),
                             F.explode(F.array(*[F.col(c) for c in item_texts])).alias("text")).dropna().distinct()
    parts = blocks(sorted((r["name"], r["text"].encode()) for r in named.toLocalIterator()), most_bytes)
    return [benchmark.sparkSession.sparkContext.broadcast(tuple(part)) for part in parts]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",), most_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, items met (as text, sorted), spans of hit words in code points of the original text.

    benchmark holds the questions and answers in the columns item_texts; each column is an item text of its own. It is a stated
    test set and goes to the tasks in automata over at most most_bytes of item text; a larger one is scanned in several blocks, and
    spans of different blocks may overlap. Null texts have no words; null item ids are kept as the name "null"; repeated
    rows of docs give repeated rows.
    """
    sent = _sent(benchmark, item_id, item_texts, most_bytes)
    docs = narrow(docs, doc_id=id_col, text=text_col)
    schema = SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = utf8(batch.column(1))
            met, runs, sizes = [set() for _ in texts], [[] for _ in texts], [0] * len(texts)
            for part in sent:
                automaton = _automaton(part.value, width)
                for k, text in enumerate(texts):
                    sizes[k], items, spans = scan(text, automaton)
                    met[k] |= items
                    runs[k] += spans
            rows = []
            for text, found in zip(texts, runs, strict=True):
                bounds = [m.span() for m in WORD.finditer(text.decode())] if found else []
                rows.append([{"start": bounds[a][0], "end": bounds[a + n - 1][1], "first_word": a, "n_words": n} for a, n in merged(found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([sorted(m) for m in met], pa.list_(pa.string())),
                 pa.array(rows, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "first_word", "n_words")])))],
                ["doc_id", "n_words", "items", "spans"])

    return docs.mapInArrow(work, schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_id: str = "item_id",
                   item_texts: tuple[str, ...] = ("text",), most_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs without any window of the benchmark, every column as it was; null and empty texts stay."""
    sent = _sent(benchmark, item_id, item_texts, most_bytes)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = utf8(batch.column(at))
            clean = np.ones(len(texts), bool)
            for part in sent:
                automaton = _automaton(part.value, width)
                clean &= [not scan(text, automaton)[1] for text in texts]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(work, docs.schema)
