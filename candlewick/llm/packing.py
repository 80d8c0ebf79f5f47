"""Best-fit packing of token pieces into sequences of bounded length, by minimum bin slack.

The fullest sequence that the remaining lengths allow is found by a bitset subset-sum; it is taken as often as the counts of its
lengths allow, then the next. The search sees only how many pieces of each length there are, at most `capacity` numbers, so the
plan is the same work for any corpus; pieces get their places from their rank among those of equal length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, slices, stored

#: White space of Unicode. No token spans from another character to one of these, so texts can be cut there.
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Chunks whose ids a worker remembers at a time.
REMEMBERED = 400_000


class Encoder(dict):
    """ids of each chunk as little-endian 32-bit numbers, remembered. The ids are those that `tokenizers` gives for the file."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        # the byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on
        printable = {ord(c) for c in ByteLevel.alphabet() if ord(c) < 256}
        others = iter(range(256, 512))
        byte_of = {chr(b if b in printable else next(others)): b for b in range(256)}
        with open(vocabulary, encoding="utf-8") as file:
            stored = json.load(file)
        vocab = stored["model"]["vocab"]
        if any(t[k] for t in stored["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in or ask for their surroundings are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in stored["added_tokens"]}
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and token not in self.added}
        self.bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if chunk[-1] in ".," and chunk[:-1].removeprefix(" ").isalpha():  # a word and a mark are always two tokens
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            ids = np.array(self.bpe.encode_ordinary(chunk), "<u4").tobytes()
        self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Added tokens are found first and have one id each; what is between them is encoded by itself."""
        out, done = [], 0
        for hit in self.split.finditer(text):
            out += [*map(self.__getitem__, CHUNK.findall(text[done:hit.start()])), self.added[hit[0]]]
            done = hit.end()
        return b"".join([*out, *map(self.__getitem__, CHUNK.findall(text[done:]))])


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a text's pieces: as few as possible, all full but the first."""
    head = total if total <= capacity else total % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], lane): the tokens of every row's text and then end_id, cut at capacity.

    Null and empty texts are one piece of end_id alone. Repeated rows give repeated pieces. Added tokens of the
    vocabulary have their one id. lane numbers the rows of a task; ranks use it to split what lengths share.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lane = encoder(vocabulary), 0
        for batch in slices(batches, "text"):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = encode.text(text or "") + end
                for k, (at, size) in enumerate(cuts(len(tokens) // 4, capacity)):
                    part = tokens[4 * at:4 * (at + size)]
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = {"doc_id": batch.column(0).take(pa.array(rows)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                       "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            columns["lane"] = pa.array(np.arange(lane, lane + len(rows)))
            lane += len(rows)
            yield pa.RecordBatch.from_pydict(columns)

    extra = "ids array<int>, " if with_ids else ""
    return docs.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, {extra}lane long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum is as near to room as it can be without passing it; larger lengths first."""
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        some, left = 1, min(counts[length], room // length)
        while left:
            times = min(some, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left -= times
            some *= 2
        if reach >> room:
            break
    target, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> target & 1:
            taken[length] = taken.get(length, 0) + times
            target -= length * times
    return taken


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a sequence, how many such sequences): the longest piece left, with the fullest combination of the others beside it."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        taken = fullest({n: c for n, c in rest.items() if c}, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[n] // used for n, used in taken.items())
        out.append((taken, times))
        for n, used in taken.items():
            left[n] -= used * times
            if not left[n]:
                del left[n]
    return out


#: Ranks within a length stay below this.
RANKS = 1 << 44


def places(steps: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length and first rank as one number, first rank, uses in a sequence, first sequence, offset there), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for taken, times in steps:
        offset = 0
        for length in sorted(taken, reverse=True):
            rank = used.get(length, 0)
            rows.append((length * RANKS + rank, rank, taken[length], sequence, offset))
            used[length] = rank + taken[length] * times
            offset += length * taken[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """items with sequence_id and offset. items: column length (1 to capacity) and lane; other columns are kept.

    Only the number of items of each length, at most `capacity` rows, comes to the driver. Equal lengths are split into about
    the square root of the row count many lanes before they are numbered, so a length that many share is no single task.
    """
    items = stored(items, "pieces")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    where = places(plan(counts, capacity))
    lanes = math.isqrt(sum(counts.values())) + 1
    laned = items.withColumn("lane", F.pmod("lane", F.lit(lanes)))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laned.groupBy("length", "lane").agg(F.count("*").alias("n")).select(
        "length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "lane").orderBy(*[c for c in ("doc_id", "piece") if c in items.columns] or ["lane"]))
    ranked = laned.join(offsets, ["length", "lane"]).select(*[c for c in items.columns if c != "lane"], (F.col("before") + within - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            _, first, uses, sequence, offset = where[np.searchsorted(where[:, 0], length * RANKS + rank, "right") - 1].T
            turn, slot = np.divmod(rank - first, uses)
            kept = [k for k, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(sequence + turn), pa.array(offset + slot * length)],
                                             [*[batch.schema.names[k] for k in kept], "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, vocabulary: str, capacity: int = 1024, **how) -> DataFrame:
    """Every piece of every row of docs with its sequence and offset."""
    return pack(pieces(docs, vocabulary, capacity, **how), capacity)
