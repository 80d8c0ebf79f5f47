"""Repeated lines across documents: explode, hash, count documents a hash, drop, and put the rest together by position.

Only hashes and positions of lines are shuffled to be counted; each text is shuffled once, to meet the positions that it loses.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import narrow, stored

#: Stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: A key with more than one in so many of all counted lines is hot, so there are fewer hot keys than this.
SHARE = 256
#: Rows of a hot key are dealt to so many groups.
SALTS = 64


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def both_hashes(value: Column, one: str, two: str) -> list[Column]:
    """128 bits of a text as two longs."""
    return [F.xxhash64(value).alias(one), F.xxhash64(F.lit(1), value).alias(two)]


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2): every line whose key has at least min_chars code points; t1 and t2 stand for the whole text."""
    # a key is no longer than its line, and code points are no more than bytes: a cheap test before the key is made
    lines = docs.select("doc_id", *both_hashes(F.coalesce("text", F.lit("")), "t1", "t2"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.filter(F.octet_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "t1", "t2", "pos", *both_hashes(F.col("key"), "h1", "h2"))


def spread_join(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """lines joined with frequent on (h1, h2), each hot key in SALTS groups. frequent: (h1, h2, n, last), each key once.

    A hot key has over 1/SHARE of the counted lines, so fewer than SHARE rows are broadcast.
    """
    total = frequent.agg(F.sum("n")).first()[0] or 0
    salts = F.when(F.col("n") > total // SHARE, SALTS).otherwise(1)
    hot = frequent.filter(F.col("n") > total // SHARE).select("h1", "h2", F.lit(SALTS).alias("salts"))
    dealt = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.coalesce("salts", F.lit(1))).cast("int"))
    copies = frequent.select("h1", "h2", "last", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return dealt.join(copies, ["h1", "h2", "salt"])


def remaining(lines: Column, dropped: Column) -> Column:
    """lines without those at the positions of dropped, in rising order: the stretches between them, so that the work is linear."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), one row per row of docs.

    A key of at least min_chars code points found in at least min_docs documents loses all its lines but those in the largest id that holds it.
    Null and empty texts are one empty line. Rows that share an id, a null id included, are one document in the count, and each row has
    its own result; a null id is smaller than all others. No rows give no rows.
    """
    docs = narrow(docs, doc_id=id_col, text=text_col)
    lines = keyed_lines(docs, min_chars)
    once = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    frequent = stored(once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs), "frequent-lines")
    lost = spread_join(lines, frequent).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    # equal rows lose equal positions, once each
    listed = lost.groupBy(F.col("doc_id").alias("of"), "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    marked = docs.select("doc_id", "text", *both_hashes(F.coalesce("text", F.lit("")), "t1", "t2"))
    met = marked.join(listed, marked["doc_id"].eqNullSafe(listed["of"]) & (marked["t1"] == listed["t1"]) & (marked["t2"] == listed["t2"]), "left")
    whole = F.coalesce("text", F.lit(""))
    # one pass over an array of one binds the split text, so that it is not split again for every stretch
    rest = F.transform(F.array(split_lines(F.col("text"))), lambda lines: F.array_join(remaining(lines, F.col("dropped")), "\n"))[0]
    return met.select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
                      F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
                      F.when(F.col("dropped").isNull(), whole).otherwise(rest).alias("kept"))
