"""GARCH(1,1) forecasts: the variance of the next bar from the last squared return and the last variance, fitted to every asset by likelihood.

The recursion h' = w + a x^2 + b h is a map h -> m h + c, and maps of consecutive stretches compose. So a long series is cut into segments: a first
pass gives each segment's map for every point of a parameter grid, a fold of the maps gives the variance that each segment starts from, and a
second pass adds up the likelihood. Assets of a batch and points of the grid go through the recursion side by side. Rounds of finer
grids around the best point follow. w is set so that the long-run variance is that of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.segments import ROWS, with_position
from candlewick.functions.tables import stored

#: Points of the grid on either side of its centre, for both parameters.
ARMS = 3
#: First centre and step of (a, b), and by how much the step falls from round to round.
CENTRE, STEP, FINER, ROUNDS = (0.15, 0.7), (0.045, 0.09), 0.4, 7
#: a + b stays below this.
MOST = 0.9999
#: Values that a task holds in a recursion at a time.
HELD = 1 << 21


def grid(a: np.ndarray, b: np.ndarray, step: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (series, points) around the centres, inside the region where they are allowed; the centre is the middle point."""
    arm = np.arange(-ARMS, ARMS + 1)
    one, other = (x.ravel() for x in np.meshgrid(arm * step[0], arm * step[1], indexing="ij"))
    alpha = np.clip(a[:, None] + one, 1e-6, MOST)
    beta = np.clip(b[:, None] + other, 0.0, MOST)
    over = np.maximum(alpha + beta, MOST) / MOST
    return alpha / over, beta / over


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Squares (series, longest), and the lengths."""
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten()) ** 2
    return out, sizes


def _parts(batches: Iterator[pa.RecordBatch], points: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a recursion holds a bounded number of values; a series longer than that comes alone."""
    for batch in batches:
        sizes, first, held = np.diff(np.asarray(batch.column("x").offsets)), 0, 0
        for row, size in enumerate(sizes):
            if row > first and held + int(size) + points > HELD:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += int(size) + points
        if batch.num_rows > first:
            yield batch.slice(first)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def series_of(returns: DataFrame, value: str = "ret", rows: int = ROWS) -> DataFrame:
    """(symbol, segment, var, x): stretches of at most `rows` centred returns, in order; var is the whole series' variance."""
    all_ = Window.partitionBy("symbol")
    centred = returns.filter(F.col(value).isNotNull()).select("symbol", "ts", (F.col(value) - F.avg(value).over(all_)).alias("x"))
    placed = with_position(centred, rows).withColumn("segment", F.floor(F.col("_pos") / rows))
    packed = placed.groupBy("symbol", "segment").agg(F.sort_array(F.collect_list(F.struct("_pos", "x"))).alias("s"))
    sized = packed.select("symbol", "segment", F.col("s.x").alias("x")).withColumn("ss", F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
    both = sized.withColumns({"var": F.sum("ss").over(all_) / F.sum(F.size("x")).over(all_), "n": F.sum(F.size("x")).over(all_)})
    return both.filter("var > 0").select("symbol", "segment", "var", "n", "x")


def _maps(rows: DataFrame, step: tuple[float, float]) -> DataFrame:
    """(symbol, segment, m, c): each segment's map, an entry per point. rows: (symbol, segment, var, x, a, b)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, (2 * ARMS + 1) ** 2):
            squares, sizes = _padded(batch.column("x"))
            a, b = grid(*(np.asarray(batch.column(k)) for k in ("a", "b")), step)
            w, c = (1 - a - b) * np.asarray(batch.column("var"))[:, None], np.zeros_like(a)
            for t in range(squares.shape[1]):
                on = t < sizes[:, None]
                c = np.where(on, w + a * squares[:, t:t + 1] + b * c, c)
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("segment"), _lists(b ** sizes[:, None]), _lists(c)], ["symbol", "segment", "m", "c"])

    return rows.mapInArrow(work, "symbol string, segment long, m array<double>, c array<double>")


def _scores(rows: DataFrame, step: tuple[float, float]) -> DataFrame:
    """(symbol, a, b, score, h): log likelihood of each point over one segment from its start; h is the variance after its last value."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, (2 * ARMS + 1) ** 2):
            squares, sizes = _padded(batch.column("x"))
            a, b = grid(*(np.asarray(batch.column(k)) for k in ("a", "b")), step)
            w, h = (1 - a - b) * np.asarray(batch.column("var"))[:, None], np.asarray(batch.column("start").flatten()).reshape(a.shape)
            score = np.zeros_like(a)
            for t in range(squares.shape[1]):
                on, x = t < sizes[:, None], squares[:, t:t + 1]
                score -= np.where(on, 0.5 * (np.log(h) + x / h), 0.0)
                h = np.where(on, w + a * x + b * h, h)
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("segment"), *map(_lists, (a, b, score, h))], ["symbol", "segment", "a", "b", "score", "h"])

    return rows.mapInArrow(work, "symbol string, segment long, a array<double>, b array<double>, score array<double>, h array<double>")


def garch(returns: DataFrame, value: str = "ret", rows: int = ROWS, min_rows: int = 30, rounds: int = ROUNDS) -> DataFrame:
    """(symbol, n, omega, alpha, beta, log_likelihood, forecast_variance, forecast_volatility) for each asset with min_rows returns or more.

    Returns are taken less their mean; the first variance is the sample's, and the constant of the likelihood is left out. Series without
    variance are left out.
    """
    series = stored(series_of(returns, value, rows).filter(F.col("n") >= min_rows), "garch-series")
    points = (2 * ARMS + 1) ** 2
    best = series.filter("segment = 0").select("symbol", F.lit(CENTRE[0]).alias("a"), F.lit(CENTRE[1]).alias("b"))
    step = STEP
    for k in range(rounds):
        rows_ = series.join(best.select("symbol", "a", "b"), "symbol")
        if k == 0:
            several = not series.filter("segment > 0").isEmpty()
        first = F.array_repeat("var", points)
        if several:
            before = Window.partitionBy("symbol").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
            told = _maps(rows_, step).withColumn("maps", F.collect_list(F.struct("m", "c")).over(before)).select("symbol", "segment", "maps")
            through = F.aggregate("maps", first, lambda h, s: F.zip_with(F.zip_with(h, s["m"], lambda p, q: p * q), s["c"], lambda p, q: p + q))
            begun = rows_.join(told, ["symbol", "segment"]).withColumn("start", through).drop("maps")
        else:
            begun = rows_.withColumn("start", first)
        each = _scores(begun.select("symbol", "segment", "var", "x", "a", "b", "start"), step)
        # points that were moved to the edge of the region may be equal: of equal scores the first counts
        flat = each.select("symbol", "segment", F.posexplode(F.arrays_zip("a", "b", "score", "h")).alias("point", "p"))
        total = flat.groupBy("symbol", "point").agg(F.sum("p.score").alias("score"), F.first("p.a").alias("a"), F.first("p.b").alias("b"), F.max_by("p.h", "segment").alias("h"))
        top = total.groupBy("symbol").agg(F.max_by(F.struct("a", "b", "score", "h"), F.struct("score", (-F.col("point")).alias("o"))).alias("t"))
        best = stored(top.select("symbol", "t.*"), "garch-best")
        step = (step[0] * FINER, step[1] * FINER)
    known = series.filter("segment = 0").select("symbol", "n", "var")
    return best.join(known, "symbol").select("symbol", "n", ((1 - F.col("a") - F.col("b")) * F.col("var")).alias("omega"), F.col("a").alias("alpha"), F.col("b").alias("beta"),
                                             F.col("score").alias("log_likelihood"), F.col("h").alias("forecast_variance"), F.sqrt("h").alias("forecast_volatility"))
