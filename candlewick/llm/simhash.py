"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, linked when few bits differ."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from candlewick.llm.components import components
from candlewick.llm.shared import narrow, slices, stored, utf8

SEED = 42
#: Eight bits of a byte, highest first, as eight one-byte counters.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
#: So many one-byte counters are added before they are widened.
NARROW = 255


def shingle_digests(text: bytes, width: int) -> list[bytes]:
    """XXH64 of each run of `width` lower-cased words, one space between; a shorter text is one run, an empty one none."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_digest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxh64_digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[width - 1:], strict=False)]


def majority(digests: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that are set in over half its digests. digests: (n, 8) bytes; sizes: digests of each text."""
    out = np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    pieces = -(-sizes // NARROW)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sums = np.add.reduceat(SPREAD[digests], np.repeat(first, pieces) + inner * NARROW, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    out[full] = np.packbits(counts * 2 > sizes[:, None], axis=1).view(">i8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is a long. Null and wordless texts have fp 0; a null id stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingle_digests(x, width) for x in utf8(batch.column(1))]
            flat = np.frombuffer(b"".join(b"".join(x) for x in found), np.uint8).reshape(-1, 8)
            fps = majority(flat, np.array([len(x) for x in found], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    docs = narrow(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, max_distance: int) -> list[int]:
    """Bit masks of every choice of blocks - max_distance blocks: fingerprints that close agree on one choice at least."""
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - max_distance)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, max_distance: int = 2, blocks: int = 4, together: int = 64) -> DataFrame:
    """(a, b) edges between distinct fingerprints that connect all fingerprints with at most max_distance differing bits.

    fps: column fp. Fingerprints are joined on each choice of agreeing blocks and the distance of each pair is verified. Where
    more than `together` fingerprints share a block choice, pairs would grow with the square, so those fingerprints
    meet at midpoints instead: two of them are within the distance exactly if some 64-bit value is within half of it of both.
    Each is linked to the smallest at that midpoint; these links connect the same fingerprints. max_distance is 0 or 2.
    """
    if max_distance not in (0, 2):
        raise ValueError("max_distance is 0 or 2")
    distinct = fps.select("fp").dropna().distinct()
    near = F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("key"))
                     for k, m in enumerate(block_masks(blocks, max_distance))])
    keyed = stored(distinct.select("fp", F.inline(near)), "blocks")
    sizes = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(keyed.join(sizes, ["c", "key"]), "blocks")
    few = met.filter(F.col("n") <= together)
    other = few.select("c", "key", F.col("fp").alias("b"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = few.withColumnRenamed("fp", "a").join(other, ["c", "key"]).filter((F.col("a") > F.col("b")) & (far <= max_distance)).select("a", "b")
    flips = [F.lit(0).cast("long")] + [F.lit(_long(1 << k)) for k in range(64)] * (max_distance // 2)
    around = stored(met.filter(F.col("n") > together).select("fp").distinct()
                    .select(F.col("fp").alias("a"), F.explode(F.transform(F.array(*flips), lambda x: x.bitwiseXOR(F.col("fp")))).alias("mid")),
                    "midpoints")
    least = around.groupBy("mid").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return pairs.union(around.join(least, "mid").filter("a > b").select("a", "b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_distance: int = 2,
           blocks: int = 4, together: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest id reachable over fingerprints that differ in max_distance bits or fewer, itself included; rows of
    one fingerprint are one node, so copies never become pairs. Null and wordless texts share fingerprint zero. A null id
    stays null and is never the smallest unless its group has no other. Repeated rows give repeated rows.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    roots = components(links(fps, max_distance, blocks, together)).withColumnRenamed("node", "fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """The fingerprint as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest id, every column as it was.

    Rows without an id can't be named by others and stay. Of repeated rows with the smallest id all stay.
    """
    out = groups(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, **how)
    drop = out.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti").select(*docs.columns)
