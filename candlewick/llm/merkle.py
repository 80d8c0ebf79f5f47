"""A Merkle manifest of a dataset: roots that name its exact content, and for every row the siblings that prove it belongs.

Each round is a slot pivot: conditional aggregates spread the nodes below a parent into slot columns, several levels at a time (fanout ** span columns).
Concatenated columns, `fanout` at a time, are hashed level by level; the columns of a run without the own slot are a node's siblings. Rounds
shrink by fanout ** span, and only digests are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.llm.shared import stored


def digest(value: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(value.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, null as a dash."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(one, values)))


def part_key(value: Column) -> Column:
    """A text that sorts as the value does by bytes, with null first and never null itself."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `idx`, the place from 0 in each `part` by the order columns, nulls first. rows: stored, with column part.

    Rows are sorted by ranges, numbered inside a range and moved by the counts of the ranges before, so a part with most rows is no single task.
    """
    cut = rows.repartitionByRange("part", *order).withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range", "part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = stored(cut.withColumn("at", F.row_number().over(inside)), "merkle-ranges")
    sizes = local.groupBy("part", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("part", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return local.join(moved, ["part", "range"]).withColumn("idx", F.col("before") + F.col("at") - 1).drop("range", "at", "before")


def _parents(level: Column, fanout: int) -> Column:
    """Digests of each run of fanout nodes of a level, the last run shorter."""
    starts = F.sequence(F.lit(1), F.size(level), F.lit(fanout))
    return F.transform(starts, lambda at: digest(F.array_join(F.slice(level, at, fanout), "")))


def _rounds(nodes: DataFrame, fanout: int, span: int) -> list[DataFrame]:
    """A stored table for each round: (part, idx, levels, left, top, digest). nodes: (part, idx, digest), stored.

    A row is a group of fanout ** span nodes; levels[k] has its nodes k levels up, `left` levels in all. top: the group is the last of its part.
    """
    width = fanout ** span
    height = sum((F.when(F.col("n") > fanout ** k, 1).otherwise(0) for k in range(64) if fanout ** k < 1 << 62), F.lit(0))
    parts = stored(nodes.groupBy("part").agg(F.count("*").alias("n")).select("part", height.alias("height")), "merkle-parts")
    highest = parts.agg(F.max("height")).first()[0] or 0
    out: list[DataFrame] = []
    while True:
        done = span * len(out)
        slots = [F.max(F.when(F.pmod("idx", F.lit(width)) == s, F.col("digest"))).alias(f"slot{s}") for s in range(width)]
        groups = nodes.groupBy("part", F.expr(f"idx div {width}").alias("idx")).agg(*slots)
        # filled from the left: what is there comes first
        first = F.array_compact(F.array(*[F.col(f"slot{s}") for s in range(width)]))
        placed = groups.join(parts, "part").select("part", "idx", first.alias("first"), F.least(F.col("height") - done, F.lit(span)).alias("left"),
                                                   (F.col("height") <= done + span).alias("top"))
        steps = F.slice(F.array(*map(F.lit, range(span))), F.lit(1), F.col("left"))
        levels = F.aggregate(steps, F.array("first"), lambda have, _: F.concat(have, F.array(_parents(F.element_at(have, -1), fanout))))
        rows = placed.select("part", "idx", levels.alias("levels"), "left", "top")
        out.append(stored(rows.withColumn("digest", F.element_at(F.element_at("levels", -1), 1)), "merkle-round"))
        if done + span >= highest:
            return out
        nodes = out[-1].filter("not top").select("part", "idx", "digest")


def _siblings(levels: Column, left: Column, slot: Column, fanout: int, span: int) -> Column:
    """For each level of a group the run of the node above the slot without that node: what stands before it and after it, joined."""
    def one(k: Column) -> Column:
        level, at = levels[k], F.floor(slot / F.array(*[F.lit(fanout ** j) for j in range(span)])[k]).cast("int")
        inside = F.pmod(at, F.lit(fanout))
        return F.struct(F.array_join(F.slice(level, at - inside + 1, inside), "").alias("before"),
                        F.array_join(F.slice(level, at + 2, F.lit(fanout - 1) - inside), "").alias("after"))

    return F.transform(F.slice(F.array(*map(F.lit, range(span))), F.lit(1), left), one)


def _proven(nodes: DataFrame, rounds: list[DataFrame], above: DataFrame, fanout: int, span: int) -> DataFrame:
    """nodes with `path`, the siblings up to the part's top and on from there, and the columns of above. above: (part, path, ...), each part once.

    From the top round down: a part's last group takes its path from above, every other group from its slot in the group over it.
    """
    width = fanout ** span
    kept = [c for c in above.columns if c not in ("part", "path")]
    own = lambda: F.concat(_siblings(F.col("levels"), F.col("left"), F.col("slot"), fanout, span), F.col("path"))
    over = None
    for table in reversed(rounds):
        here = table.filter("top").join(above, "part").select("part", "idx", "levels", "left", "path", *kept)
        if over is not None:
            below = over.select("part", "idx", "levels", "left", "path", *kept, F.explode(F.sequence(F.lit(0), F.size(F.col("levels")[0]) - 1)).alias("slot"))
            below = below.select("part", (F.col("idx") * width + F.col("slot")).alias("idx"), own().alias("path"), *kept)
            here = here.unionByName(table.filter("not top").join(below, ["part", "idx"]).select("part", "idx", "levels", "left", "path", *kept))
        over = here
    over = over.withColumnRenamed("idx", "group")
    spread = nodes.withColumn("group", F.expr(f"idx div {width}")).withColumn("slot", F.pmod("idx", F.lit(width)).cast("int"))
    return spread.join(over, ["part", "group"]).withColumn("path", own()).drop("group", "slot", "levels", "left")


def manifest(leaves: DataFrame, part_col: str = "lang", id_col: str = "doc_id", leaf_col: str = "leaf", fanout: int = 2, span: int = 4) -> DataFrame:
    """Every row of leaves with subroot, root and path: an array, from the leaf up, of (before, after), the digests of a run on both sides of the node.

    Leaves of a part are ordered by id, a null id first, and by digest where ids repeat; repeated rows are leaves of their own. Parts, null
    first, are ordered by bytes. Runs of `fanout` nodes become their digest while several remain. All columns of leaves stay, but columns named
    subroot, root or path give way to the results. No rows give no rows.
    """
    own = [F.col(f"`{c}`") for c in leaves.columns if c not in ("subroot", "root", "path")]
    rows = stored(leaves.select(F.struct(*own).alias("row"), part_key(F.col(f"`{part_col}`")).alias("part"), F.col(f"`{id_col}`").alias("id"),
                                F.col(f"`{leaf_col}`").alias("digest")), "merkle-leaves")
    nodes = stored(numbered(rows, "id", "digest"), "merkle-numbered")
    rounds = _rounds(nodes.select("part", "idx", "digest"), fanout, span)
    tops = [r.filter("top").select(F.col("part").alias("name"), "digest") for r in rounds]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    subroots = stored(subroots.withColumn("part", F.lit("")), "merkle-subroots")
    named = stored(numbered(subroots, "name"), "merkle-subroots")
    upper = _rounds(named.select("part", "idx", "digest"), fanout, span)
    root = upper[-1].filter("top").select("part", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("path"))
    above = _proven(named, upper, root, fanout, span).select(F.col("name").alias("part"), "path", F.col("digest").alias("subroot"), "root")
    # a row a part, read by each round
    return _proven(nodes, rounds, stored(above, "merkle-above"), fanout, span).select("row.*", "subroot", "root", "path")


def folded(value: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, value, lambda have, step: digest(F.concat(step["before"], have, step["after"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))
