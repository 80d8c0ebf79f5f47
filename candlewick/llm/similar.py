"""Near copies by similarity of shingle sets, where SimHash bits alone are too coarse.

At a set similarity of 0.8 about 15 % of SimHash bits differ, more than blocks can find. So the pigeonhole runs over a second fingerprint: 128
positions, each the least of one hash over the shingles, which agree in about the share of the similarity. That share is too rough to decide on,
so it only finds candidates: a pair that differs at no more than `loose(similarity)` positions (40 at 0.8) leaves one of that many blocks and one equal, and a
pair at the similarity differs at more with a chance below 0.001 (binomial), at a higher one with less. Candidates are decided by the shingle sets
themselves, which are made again from the texts of candidates alone: tables and shuffles of all documents hold fingerprints and sketches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xxhash import xxh128_digest

from candlewick.llm.components import components
from candlewick.llm.shared import few_files, kept, narrow, passing, released, slices, stored, utf8
from candlewick.llm.simhash import SEED, links, majority, shingle_digests

POSITIONS = 128
#: One multiply-and-add hash a position.
TIMES, PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, POSITIONS), np.uint64) | np.array([[1], [0]], np.uint64)
#: Chance that a pair at the similarity itself is no candidate, at most.
MISSED = 0.001
#: Shingles that are hashed at a time.
STEP = 1024


def loose(similarity: float) -> int:
    """Positions at which the sketches of a candidate pair may differ."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity is 0.5 to 1")
    apart, left = -1, 1.0
    while left > MISSED and apart < POSITIONS - 1:
        apart += 1
        left -= comb(POSITIONS, apart) * (1 - similarity) ** apart * similarity ** (POSITIONS - apart)
    return apart


def minima(digests: np.ndarray) -> bytes:
    """The least of each hash over the distinct shingles, 32 bits a position; zeros without shingles. digests: 64-bit numbers."""
    if not len(digests):
        return bytes(4 * POSITIONS)
    distinct = np.unique(digests)
    parts = [((distinct[k:k + STEP, None] * TIMES + PLUS) >> np.uint64(32)).min(axis=0) for k in range(0, len(distinct), STEP)]
    return np.min(parts, axis=0).astype("<u4").tobytes()


def hashed(texts: pa.Array, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """SimHash of each text, and its distinct shingle hashes in order."""
    found = [np.frombuffer(b"".join(shingle_digests(x, width)), np.uint8) for x in utf8(texts)]
    flat = np.concatenate(found).reshape(-1, 8) if found else np.zeros((0, 8), np.uint8)
    return majority(flat, np.array([len(x) // 8 for x in found], np.int64)), [np.unique(x.view("<u8")) for x in found]


def set_key(shingles: np.ndarray) -> bytes:
    return xxh128_digest(shingles.tobytes())


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, key, size, sketch): SimHash, a hash and the number of the distinct shingles, minima; wordless texts have zeros."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps, sets = hashed(batch.column(1), width)
            columns = [batch.column(0), pa.array(fps), pa.array([set_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()),
                       pa.array([minima(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "key", "size", "sketch"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, key binary, size int, sketch binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the given nodes (node, key), made from the texts that bear their ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = hashed(batch.column(1), width)[1]
            columns = [batch.column(0), pa.array([set_key(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "key", "shingles"])

    texts = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    made = texts.mapInArrow(work, f"node {docs.schema['doc_id'].dataType.simpleString()}, key binary, shingles binary")
    # an id may stand for several texts, and a text may come several times
    return made.join(nodes, ["node", "key"]).dropDuplicates(["node", "key"]).select("node", "shingles")


def verified(pairs: DataFrame, nodes: DataFrame, apart: int, share: float = 0.0) -> DataFrame:
    """The pairs (a, b) whose sketches differ at no more than `apart` positions, and of whose set sizes the smaller has that share of the other."""
    sized = nodes if "size" in nodes.columns else nodes.withColumn("size", F.lit(1))
    side = lambda name: sized.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, POSITIONS) for k in (2, 3))
                near = (one != other).sum(axis=1) <= apart
                yield batch.select(["a", "b"]).filter(pa.array(near))

    fits = F.least("size_a", "size_b") >= share * F.greatest("size_a", "size_b") - 1e-9
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).select("a", "b", "sketch_a", "sketch_b")
    return joined.mapInArrow(work, pairs.select("a", "b").schema)


def alike(one: bytes, other: bytes, similarity: float) -> bool:
    """Whether two sets, distinct 64-bit numbers in order, have at least that share of their union in common. Empty sets are alike."""
    a, b = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
    least, most = sorted((len(a), len(b)))
    if least < similarity * most - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - 1e-9


def decided(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (a, b), each once, whose shingle sets are alike. sets_of: from (node) to (node, shingles); a pair without sets is none."""
    pairs = stored(few_files(pairs.distinct()), "minima-candidates")
    ends = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    needed = stored(sets_of(ends), "minima-sets")
    side = lambda name: needed.select(F.col("node").alias(name), F.col("shingles").alias(f"shingles_{name}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "shingles_a"):
                near = [alike(one.as_py(), other.as_py(), similarity) for one, other in zip(batch.column(2), batch.column(3), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shingles_a", "shingles_b")
    return joined.mapInArrow(work, pairs.schema)


def _crossing(open_: DataFrame, nodes: DataFrame, apart: int) -> DataFrame:
    """(a, b) of different groups, the pairs that may be close. open_: (node, group, outside), each node once.

    Two sketches that differ at no more than `apart` positions share one of the apart + 1 values that are rarest, over all of open_, in each.
    Passages that many texts share are common values, so they bring no pairs.
    """
    values = [F.xxhash64(F.lit(k), F.substring("sketch", 4 * k + 1, 4)) for k in range(POSITIONS)]
    tokens = stored(open_.join(nodes, "node").select("node", "group", "outside", F.explode(F.array(*values)).alias("token")), "minima-values")
    common = tokens.groupBy("token").agg(F.count("*").alias("n"), (F.min("group") != F.max("group")).alias("mixed"))
    rarest = tokens.join(common, "token").groupBy("node", "group", "outside").agg(F.sort_array(F.collect_list(F.struct("n", "token", "mixed"))).alias("by_n"))
    held = stored(rarest.select("node", "group", "outside", F.inline(F.slice("by_n", 1, apart + 1))).filter("mixed"), "minima-rarest")
    one = held.filter("outside").select("token", F.col("node").alias("x"), F.col("group").alias("other"))
    pairs = held.join(one, "token").filter("group <> other and (node > x or not outside)")
    return pairs.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b")).distinct()


#: A token with more than one in so many of all tokens is hot, so there are fewer hot tokens than this; its rows are dealt to so many groups.
SHARE, SALTS = 256, 32
#: Words of 64 bits in a set's parities.
PARITIES = 16


def _tokens(sets: DataFrame) -> DataFrame:
    """(node, group, outside, size, token): every shingle hash of every set. sets: (node, group, outside, shingles)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "shingles"):
                found = [np.frombuffer(x, "<i8") for x in utf8(batch.column(3))]
                sizes = np.array([len(x) for x in found], np.int64)
                rows = pa.array(np.repeat(np.arange(len(found)), sizes))
                columns = [batch.column(k).take(rows) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(found))],
                                                 ["node", "group", "outside", "size", "token"])

    kind = sets.schema["node"].dataType.simpleString()
    return sets.select("node", "group", "outside", "shingles").mapInArrow(work, f"node {kind}, group {kind}, outside boolean, size int, token long")


def _parities(tokens: DataFrame) -> DataFrame:
    """(node, parity_0, ...): of each of 1024 parts of all hashes, whether an odd number of the node's tokens is in it.

    A part in which two sets differ holds a token that only one of them has, so they differ in no more parts than tokens.
    """
    bit = "shiftleft(1L, cast(token & 63 as int))"
    return tokens.groupBy("node").agg(*[F.expr(f"bit_xor(if((shiftrightunsigned(token, 6) % {PARITIES}) = {k}, {bit}, 0L))").alias(f"parity_{k}") for k in range(PARITIES)])


def _crossing_sets(open_: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(a, b) of different groups, the pairs that may be alike, by the sets themselves. open_: (node, group, outside), each node once.

    Two sets with that share of their union in common have one token in common among the rarest of each, all but that share and one more, by one order
    of all tokens, and after the first one enough others are left. What a passage that many texts share brings is common and comes last, so
    such texts meet only where little else is in them. Their parities differ in no more parts than tokens may, so that of a crowd of texts
    that share much but not enough few pairs are made.
    """
    sets = sets_of(open_.select("node")).join(open_, "node")
    tokens = stored(_tokens(sets), "minima-tokens")
    common = stored(few_files(tokens.groupBy("token").agg(F.count("*").alias("n"), (F.min("group") != F.max("group")).alias("mixed"))), "minima-common")
    total = common.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total // SHARE
    salts = common.filter(hot).select("token", F.lit(SALTS).alias("salts"))
    dealt = tokens.join(F.broadcast(salts), "token", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = common.select("token", "n", "mixed", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))).alias("salt"))
    rare = Window.partitionBy("node").orderBy("n", "token")
    least = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    held = stored(dealt.join(copies, ["token", "salt"]).withColumn("at", F.row_number().over(rare)).filter(F.col("at") <= least).filter("mixed")
                  .select("node", "group", "outside", "size", "token", "at").join(_parities(tokens), "node"), "minima-rarest")
    one = held.filter("outside").select("token", F.col("node").alias("x"), F.col("group").alias("other"), F.col("size").alias("size_x"), F.col("at").alias("at_x"),
                                        *[F.col(f"parity_{k}").alias(f"parity_x_{k}") for k in range(PARITIES)])
    # of the first token in common, only those that come after it can be in common too, and they must be enough
    most = 1 + F.least(F.col("size") - F.col("at"), F.col("size_x") - F.col("at_x"))
    fits = most >= similarity / (1 + similarity) * (F.col("size") + F.col("size_x")) - 1e-9
    apart = reduce(add, [F.bit_count(F.col(f"parity_{k}").bitwiseXOR(F.col(f"parity_x_{k}"))) for k in range(PARITIES)])
    near = apart <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("size_x")) + 1e-6
    pairs = held.join(one, "token").filter("group <> other and (node > x or not outside)").filter(fits & near)
    return pairs.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b")).distinct()


def similar_links(nodes: DataFrame, similarity: float = 0.8, together: int = 16, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b) edges that connect nodes whose shingle sets have a similarity of at least `similarity`. nodes: (node, sketch) and perhaps size, each once.

    sets_of gives (node, shingles) for a table of (node); the sketches of such a pair differ at no more than loose(similarity) positions but for the
    stated chance. Without it the edges connect nodes whose sketches agree at a share of `similarity` of the positions or more.

    In blocks of up to `together` nodes each pair is verified. In larger ones every node is held against one of the block; of those
    that this leaves in several groups, nodes outside a block's largest group are held against the nodes of other groups with which they
    share one of their rarest shingles, or values without sets. A group of copies is not squared, and no link between groups is lost.
    """
    apart = int(POSITIONS * (1 - similarity) + 1e-9) if sets_of is None else loose(similarity)
    close = lambda pairs: verified(pairs, nodes, apart) if sets_of is None else decided(verified(pairs, nodes, apart, similarity), sets_of, similarity)
    bounds = [POSITIONS * k // (apart + 1) for k in range(apart + 2)]
    keys = [F.xxhash64(F.lit(k), F.substring("sketch", 4 * lo + 1, 4 * (hi - lo))) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))]
    keyed = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    # the same few nodes are chosen in all blocks that they are in, so that most pairs of several blocks are one
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("pivot")).filter("n > 1")
    met = stored(keyed.join(sizes, "key"), "minima-met")
    few, many = met.filter(F.col("n") <= together), met.filter(F.col("n") > together)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a > b").select("a", "b")
    pivots = many.filter("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"))
    near = stored(close(pairs.union(pivots).distinct()), "minima-links")
    released(nodes.sparkSession)
    groups = components(near).withColumnRenamed("root", "group")
    placed = stored(many.join(groups, "node", "left").select("key", "node", F.coalesce("group", "node").alias("group")), "minima-placed")
    counts = placed.groupBy("key", "group").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    open_ = placed.join(mixed, "key").groupBy("node").agg(F.first("group").alias("group"), F.max(F.col("group") != F.col("main")).alias("outside"))
    open_ = stored(few_files(open_), "minima-open")
    released(nodes.sparkSession)
    return near.union(close(_crossing(open_, nodes, apart)) if sets_of is None else decided(_crossing_sets(open_, sets_of, similarity), sets_of, similarity))


def _dropped(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id) of the rows that go. docs: (doc_id, text), no null ids."""
    prints = stored(sketches(docs, width), "sketches")
    nodes = stored(few_files(prints.groupBy("fp", "key").agg(F.min("doc_id").alias("node"))), "nodes")
    first = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    equal = nodes.join(first, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    rep = lambda name: first.select(F.col("fp").alias(name), F.col("rep").alias(f"rep_{name}"))
    close = links(first).join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # one set may come with several fingerprints, where only the times that shingles are repeated differ
    least = nodes.groupBy("key").agg(F.min("node").alias("least"))
    same = nodes.join(least, "key").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    # of a set's rows one is read; an id may name several sets
    chosen = prints.join(least.withColumnRenamed("least", "doc_id"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    chosen = stored(chosen.select(F.col("doc_id").alias("node"), "key", "size", "sketch"), "set-sketches")
    sets_of = lambda met: shingle_sets(docs, chosen.select("node", "key").join(met, "node"), width)
    near = similar_links(chosen.select("node", "size", "sketch"), similarity, sets_of=sets_of)
    roots = components(equal.union(close).union(same).union(near))
    copies = prints.join(nodes, ["fp", "key"]).filter("doc_id <> node").select("doc_id")
    return copies.union(roots.filter("node <> root").select("node")).distinct()


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the one with the smallest id, every column as it was.

    Linked are texts whose SimHash fingerprints differ in 2 bits or fewer, and texts whose sets of shingles have that similarity or more.
    Null and wordless texts are one group. Rows without an id can't be named by others and stay. Of repeated rows with the smallest id
    all stay. Rows that share an id stay or go together.
    """
    with passing(docs.sparkSession):
        named = narrow(docs.filter(F.col(id_col).isNotNull()), doc_id=id_col, text=text_col)
        drop = kept(_dropped(named, width, similarity), "near-copies")
    return docs.join(drop.withColumnRenamed("doc_id", id_col), id_col, "left_anti").select(*docs.columns)
