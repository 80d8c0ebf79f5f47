"""Pairwise figures without joining every pair on every date.

Series are packed to one row a symbol and stretch of time, symbols are hashed to packs, and the packs are written to shared storage as a table of rows of some MB, in files
of some 64 MB. A task reads two of the files and multiplies every pack of one with every pack of the other, stretch by stretch: a cross join of rows that Spark
makes from partitions as they are, so the series are shuffled once, and what lies on disks grows with them, not with their square. A pair's sums are whole when they leave
the task, so pairs are never shuffled either, and figures of assets leave it added up. A task holds a file, a batch of pack pairs and one tile, whatever the number of assets.
Values are centred on each symbol's mean first, so that steady series at a high level keep their digits.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.rounding import tidied
from candlewick.functions.tables import stored

#: Tasks of a block-pair step, at most.
MOST_TASKS = 4096
#: Assets in a block, about.
PER_BLOCK = 128
#: Assets on each side of a tile, and the dates it is multiplied over at once.
TILE, DATES = 256, 8192
#: Bytes of values in a block, about, and the blocks that are made to keep a cluster busy where fewer could hold the values.
BLOCK_BYTES, BUSY_BLOCKS = 64 << 20, 6
#: Symbols and bytes of values in a pack, about: fewer than a tile, so that most packs are one.
PACK, PACK_BYTES = 192, 4 << 20
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Sum of the products of both squares.
SQUARES = "sxxyy"
PAIR_SCHEMA = "asset_i string, asset_j string, " + ", ".join(f"{m} double" for m in (*MOMENTS, SQUARES))


def block_count(packed: DataFrame) -> int:
    """Blocks for the symbols of a small stored table."""
    return max(1, -(-packed.select("symbol").distinct().count() // PER_BLOCK))


def to_block_pairs(rows: DataFrame, blocks: int) -> DataFrame:
    """Copy each row to the block pairs its symbol takes part in: columns `_bi`, `_bj`, own block `_b`."""
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    keyed = rows.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return keyed.withColumns({"_bi": F.least("_b", "_o"), "_bj": F.greatest("_b", "_o")}).drop("_o")


def spread(keyed: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """A set number of tasks for block-pair work: its cost grows with the square of the rows, so sizing by bytes would
    fold it into too few."""
    return keyed.repartition(min(blocks * (blocks + 1), MOST_TASKS), *keys)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (t, v) as bytes in order of time: first time and steps, which repeat and so pack well, and values."""
    for batch in batches:
        times, values = [], []
        for points in batch.column("p"):
            flat = points.values
            t, v = flat.field("t").to_numpy(), flat.field("v").to_numpy()
            order = np.argsort(t, kind="stable")
            times.append(zlib.compress(np.diff(t[order], prepend=0).tobytes(), 1))
            values.append(v[order].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("symbol"), pa.array(times, pa.binary()), pa.array(values, pa.binary())], ["symbol", "t", "v"])


def packed(series: DataFrame, value: str, chunk_days: int = 4096) -> DataFrame:
    """Stored (symbol, t, v): the non-null values of each symbol, a row for each stretch of days; symbols without any stay, with no bytes."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    point = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    rows = (series.select("symbol", t.alias("t"), F.col(value).cast("double").alias("v"))
            .groupBy("symbol", F.floor(F.col("t") / (chunk_days * 86_400_000_000)).alias("_chunk")).agg(F.collect_list(point).alias("p")))
    return stored(rows.select("symbol", "p").mapInArrow(_encode, "symbol string, t binary, v binary"), "packed-series")


def _sizes(table: DataFrame) -> tuple[int, int]:
    """Bytes of values and symbols of a packed table."""
    size = table.agg(F.sum(F.octet_length("v")).alias("b"), F.count_distinct("symbol").alias("n")).first()
    return size["b"] or 0, size["n"]


def value_blocks(table: DataFrame) -> int:
    """Blocks for a packed table: by its bytes, and some more for enough tasks if there are symbols for it."""
    return _blocks(*_sizes(table))


def _blocks(size: int, symbols: int) -> int:
    return max(1, -(-size // BLOCK_BYTES), min(BUSY_BLOCKS, -(-symbols // PER_BLOCK)))


PACKS = "pack int, names array<string>, points binary, times binary, steps binary, v binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed series, sorted by `_pack`, as a row a pack: names, points of each, all dates, and of each point the steps along those and the centred value."""

    def row(pack: int, series: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        names = sorted(series)
        whole = []
        for name in names:
            t, v = (np.concatenate(x) for x in zip(*series[name]))
            order = np.argsort(t, kind="stable")
            whole.append((t[order], v[order] - v.mean()))
        times = np.unique(np.concatenate([t for t, _ in whole]))
        made = (np.array([len(t) for t, _ in whole], np.int64), np.diff(times, prepend=0),
                np.concatenate([np.diff(np.searchsorted(times, t), prepend=0) for t, _ in whole]).astype(np.int32), np.concatenate([v for _, v in whole]))
        return pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([names], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in made)],
                                          ["pack", "names", "points", "times", "steps", "v"])

    now, series = None, {}
    for batch in batches:
        for symbol, t, v, pack in zip(*(batch.column(c).to_pylist() for c in ("symbol", "t", "v", "_pack"))):
            if pack != now and series:
                yield row(now, series)
                series = {}
            now = pack
            if v:
                series.setdefault(symbol, []).append((np.cumsum(np.frombuffer(zlib.decompress(t), np.int64)), np.frombuffer(v)))
    if series:
        yield row(now, series)


class _Block:
    """Series of one pack: sorted names, and of each the places of its dates among all dates, and its centred values."""

    def __init__(self, names: list[str], points: bytes, times: bytes, steps: bytes, v: bytes):
        self.names = names
        self.times = np.cumsum(np.frombuffer(times, np.int64))
        ends = np.cumsum(np.frombuffer(points, np.int64))[:-1]
        self.own = [np.cumsum(x) for x in np.split(np.frombuffer(steps, np.int32), ends)]
        self.values = np.split(np.frombuffer(v), ends)
        self.places = self.own

    def among(self, times: np.ndarray) -> None:
        where = np.searchsorted(times, self.times) if len(times) > len(self.times) else None
        self.places = self.own if where is None else [where[x] for x in self.own]

    def tile(self, at: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and presence of TILE symbols over the dates low to high."""
        k = min(TILE, len(self.names) - at)
        x, m = np.zeros((k, high - low)), np.zeros((k, high - low))
        for row in range(k):
            places = self.places[at + row]
            a, b = np.searchsorted(places, (low, high))
            x[row, places[a:b] - low], m[row, places[a:b] - low] = self.values[at + row][a:b], 1.0
        return x, m


def _sums(a: _Block, i: int, b: _Block, j: int, dates: int) -> dict[str, np.ndarray]:
    total: dict[str, np.ndarray] = {}
    for low in range(0, dates, DATES):
        (x, mx), (y, my) = a.tile(i, low, min(low + DATES, dates)), b.tile(j, low, min(low + DATES, dates))
        xx, yy = x * x, y * y
        part = {"n": mx @ my.T, "sx": x @ my.T, "sy": mx @ y.T, "sxx": xx @ my.T, "syy": mx @ yy.T, "sxy": x @ y.T, SQUARES: xx @ yy.T}
        total = {k: total[k] + v for k, v in part.items()} if total else part
    return total


Tile = Callable[[list[str], list[str], dict[str, np.ndarray], np.ndarray], pa.RecordBatch]


def _packs(table: DataFrame, blocks: int | None) -> DataFrame:
    """The packed series as a stored table of packs, in as many files as `value_blocks` says; `blocks`: so many packs."""
    size, symbols = _sizes(table)
    files = _blocks(size, symbols)
    packs = blocks or max(files, -(-symbols // PACK), -(-size // PACK_BYTES))
    keyed = table.withColumn("_pack", F.pmod(F.xxhash64("symbol"), F.lit(packs)).cast("int"))
    dealt = keyed.repartitionById(files, F.col("_pack") % files).sortWithinPartitions("_pack")
    return stored(dealt.mapInArrow(_pack, PACKS), "series-packs")


def _on_tiles(table: DataFrame, figures: Tile, schema: str, blocks: int | None, same: bool) -> DataFrame:
    """`figures` of every tile: names on both sides, sums, and which cells are pairs to count, each pair once; `same`: a symbol with itself as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None, None
        for batch in batches:
            for pair in range(batch.num_rows):
                a, b, *fields = (batch.column(k)[pair].as_py() for k in range(batch.num_columns))
                if a != held[0]:  # a pack meets all of the other file's one after the other
                    held = a, _Block(*fields[:5])
                own = held[1]
                other = own if a == b else _Block(*fields[5:])
                times = np.union1d(own.times, other.times)
                own.among(times), other.among(times)
                for i in range(0, len(own.names), TILE):
                    for j in range(i if own is other else 0, len(other.names), TILE):
                        s = _sums(own, i, other, j, len(times))
                        pairs = s["n"] > 0
                        if own is other and i == j:
                            pairs &= np.triu(np.ones(pairs.shape, dtype=bool), 0 if same else 1)
                        yield figures(own.names[i:i + TILE], other.names[j:j + TILE], s, pairs)

    a = _packs(table, blocks)
    b = a.select([F.col(c).alias(f"_{c}") for c in a.columns])
    # each pair of packs once, as many of them in one half of the square of files as in the other
    once = F.when((F.col("pack") + F.col("_pack")) % 2 == 0, F.col("pack") <= F.col("_pack")).otherwise(F.col("pack") > F.col("_pack"))
    # partitions are held against each other as they lie in the storage, without a shuffle or a broadcast
    joined = a.join(b.hint("shuffle_replicate_nl"), once)
    return joined.select("pack", "_pack", *a.columns[1:], *b.columns[1:]).mapInArrow(run, schema)


def _listed(left: list[str], right: list[str], pairs: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Names of the marked pairs, the smaller one first, and where sides were changed for that."""
    i, j = np.nonzero(pairs)
    names = left + right
    order = {name: k for k, name in enumerate(sorted(set(names)))}
    rank = np.array([order[name] for name in names])
    j = j + len(left)
    swap = rank[i] > rank[j]
    known = pa.array(names, pa.string())
    return known.take(pa.array(np.where(swap, j, i))), known.take(pa.array(np.where(swap, i, j))), swap


def _moment_rows(left: list[str], right: list[str], s: dict[str, np.ndarray], pairs: np.ndarray) -> pa.RecordBatch:
    a, b, swap = _listed(left, right, pairs)
    s = {k: v[pairs] for k, v in s.items()}
    for p, q in (("sx", "sy"), ("sxx", "syy")):
        s[p], s[q] = np.where(swap, s[q], s[p]), np.where(swap, s[p], s[q])
    return pa.RecordBatch.from_arrays([a, b, *(pa.array(s[m]) for m in (*MOMENTS, SQUARES))], ["asset_i", "asset_j", *MOMENTS, SQUARES])


def _corr(s: dict[str, np.ndarray]) -> np.ndarray:
    """`pair_corr` of a tile; NaN when either side is constant."""
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = s["sxx"] - s["sx"] * s["sx"] / s["n"], s["syy"] - s["sy"] * s["sy"] / s["n"]
        varies = (vx > 1e-12 * s["sxx"]) & (vy > 1e-12 * s["syy"])
        return np.where(varies, (s["sxy"] - s["sx"] * s["sy"] / s["n"]) / (np.sqrt(vx) * np.sqrt(vy)), np.nan)


def _corr_rows(left: list[str], right: list[str], s: dict[str, np.ndarray], pairs: np.ndarray, digits: int | None) -> pa.RecordBatch:
    a, b, _ = _listed(left, right, pairs)
    corr = _corr(s)[pairs] if digits is None else tidied(_corr(s)[pairs], digits)
    return pa.RecordBatch.from_arrays([a, b, pa.array(s["n"][pairs].astype(np.int64)), pa.array(corr, from_pandas=True)], ["asset_i", "asset_j", "n", "corr"])


def pair_moments(series: DataFrame, value: str, blocks: int | None = None, chunk_days: int = 4096) -> DataFrame:
    """Sums over the common dates of every pair asset_i <= asset_j of (symbol, ts, value), each value less its symbol's mean over all dates.

    Besides the MOMENTS the sums of the products of both squares, so that errors of covariances need no second pass.
    """
    return _on_tiles(packed(series, value, chunk_days), _moment_rows, PAIR_SCHEMA, blocks, same=True)


def pair_corrs(series: DataFrame, value: str, blocks: int | None = None, digits: int | None = None) -> DataFrame:
    """(asset_i, asset_j, n, corr) of every pair asset_i < asset_j with common dates: their number and the correlation over them, `digits` being those of `guards.tidy`."""
    rows = functools.partial(_corr_rows, digits=digits)
    return _on_tiles(packed(series, value), rows, "asset_i string, asset_j string, n long, corr double", blocks, same=False)


def mean_abs_corr(series: DataFrame, value: str, least: int, blocks: int | None = None) -> DataFrame:
    """(symbol, mean_abs_corr) of every symbol: over all others with `least` common dates or more, NULL without any. No pair leaves its task."""

    def both(left: list[str], right: list[str], s: dict[str, np.ndarray], pairs: np.ndarray) -> pa.RecordBatch:
        c = np.where(pairs & (s["n"] >= least), np.abs(_corr(s)), np.nan)
        known = ~np.isnan(c)
        c = np.where(known, c, 0.0)
        return pa.RecordBatch.from_arrays([pa.array(left + right, pa.string()), pa.array(np.concatenate([c.sum(1), c.sum(0)])),
                                           pa.array(np.concatenate([known.sum(1), known.sum(0)]))], ["symbol", "s", "k"])

    table = packed(series, value)
    sums = _on_tiles(table, both, "symbol string, s double, k long", blocks, same=False).groupBy("symbol").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    return table.select("symbol").distinct().join(sums, "symbol", "left").select("symbol", F.try_divide("s", "k").alias("mean_abs_corr"))


def _cov(a: str, b: str, ab: str) -> Column:
    return F.col(ab) - F.try_divide(F.col(a) * F.col(b), F.col("n"))


def pair_corr() -> Column:
    """Pearson correlation from moments; NULL when either side is constant."""
    vx, vy = _cov("sx", "sx", "sxx"), _cov("sy", "sy", "syy")
    level = lambda v, s: v > 1e-12 * F.col(s)
    return F.when(level(vx, "sxx") & level(vy, "syy"), _cov("sx", "sy", "sxy") / (F.sqrt(vx) * F.sqrt(vy)))


def pair_cov() -> Column:
    """Sample covariance from moments."""
    return F.try_divide(_cov("sx", "sy", "sxy"), F.col("n") - 1)


def pair_list(symbols: DataFrame, blocks: int = 4, ordered: bool = False) -> DataFrame:
    """All pairs of distinct symbols (one row per symbol in), built by an equi-join on block pairs."""
    sides = to_block_pairs(symbols.select("symbol").distinct(), blocks)
    a = sides.select("_bi", "_bj", F.col("symbol").alias("asset_i"), F.col("_b").alias("_ba"))
    b = sides.select("_bi", "_bj", F.col("symbol").alias("asset_j"), F.col("_b").alias("_bb"))
    both = a.join(b, ["_bi", "_bj"]).filter(
        ((F.col("_bi") == F.col("_bj")) | (F.col("_ba") != F.col("_bb"))) & (F.col("asset_i") != F.col("asset_j")))
    return (both if ordered else both.filter(F.col("asset_i") < F.col("asset_j"))).select("asset_i", "asset_j")
