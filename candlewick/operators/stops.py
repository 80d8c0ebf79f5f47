"""Stops at a distance of average true ranges, with re-entry: exits that depend on the path since the entry.

A position is flat or holds a stop. Over a run of bars it is a map from the state before to the state after: from flat a value, from a stop S a
step function of S, since S only matters by the first bar that trades below it, and that is a record low. Maps of segments are made side by side and
folded in order; then every segment is replayed from the state it starts in. A series is never in one task, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.segments import ROWS, with_position
from candlewick.functions.tables import stored

COLUMNS = ("entry", "low", "close", "atr")


def replay(entry: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, distance: float, trail: bool, stop: float | None, first: int = 0):
    """(held, stops, exits, stop after) from bar `first` on: bar by bar, the stop is looked at first, then an entry, then the stop is raised."""
    held, stops, exits = np.zeros(len(low), bool), np.full(len(low), np.nan), np.zeros(len(low), bool)
    for t in range(first, len(low)):
        if stop is not None and low[t] < stop:
            exits[t], stop = True, None
        elif stop is None and entry[t] and atr[t] == atr[t] and close[t] == close[t]:
            stop = close[t] - distance * atr[t]
        elif stop is not None and trail and atr[t] == atr[t] and close[t] == close[t]:
            stop = max(stop, close[t] - distance * atr[t])
        held[t], stops[t] = stop is not None, np.nan if stop is None else stop
    return held, stops, exits, stop


def stop_map(entry: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, distance: float, trail: bool):
    """(flat, lows, afters, raised, end): the state after the bars from flat, and from a stop S that of the first of `lows` below S, else max(S, raised).

    States are stops, NaN for flat. lows fall; end tells that a position is out by the last bar in any case, with `raised` as its state then.
    """
    level = np.where((atr == atr) & (close == close), close - distance * atr, -np.inf) if trail else np.full(len(low), -np.inf)
    best = np.maximum.accumulate(level) if len(level) else level
    # the raised stop alone takes every position out here
    out = np.flatnonzero(low[1:] < best[:-1])
    cut = int(out[0]) + 1 if len(out) else len(low)
    seen = np.where(low[:cut] == low[:cut], low[:cut], np.inf)
    least = np.minimum.accumulate(seen) if cut else seen
    records = np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1]]) & (least < np.inf)) if cut else np.zeros(0, int)
    # the state after, flat from the bar after an exit on, found from the back: an entry leads on to its own exit
    after = _from_flat(entry, low, close, atr, distance, trail, [int(r) + 1 for r in records] + [0] + ([cut + 1] if cut < len(low) else []))
    flat = lambda t: after[t]
    end = cut < len(low)
    return flat(0), least[records], np.array([flat(int(r) + 1) for r in records]), flat(cut + 1) if end else (best[-1] if len(best) else -np.inf), end


def _from_flat(entry, low, close, atr, distance, trail, starts: list[int]) -> dict[int, float]:
    """The state after the last bar from flat before each of the starts. Starts that come to one entry share what follows."""
    known: dict[int, float] = {}
    may = np.flatnonzero(entry & (atr == atr) & (close == close))
    out: dict[int, float] = {}
    for start in starts:
        path, t, state = [], start, np.nan
        while True:
            k = np.searchsorted(may, t)
            if k == len(may):
                break
            at = int(may[k])
            if at in known:
                state = known[at]
                break
            path.append(at)
            stop, t = close[at] - distance * atr[at], None
            for b in range(at + 1, len(low)):
                if low[b] < stop:
                    t = b + 1
                    break
                if trail and atr[b] == atr[b] and close[b] == close[b]:
                    stop = max(stop, close[b] - distance * atr[b])
            if t is None:
                state = stop
                break
        for at in path:
            known[at] = state
        out[start] = state
    return out


def _arrays(batch: pa.RecordBatch, row: int) -> list[np.ndarray]:
    entry, low, close, atr = (batch.column(c)[row].values for c in COLUMNS)
    floats = [np.array([np.nan if v is None else v for v in x.to_pylist()]) for x in (low, close, atr)]
    return [np.array([bool(v) for v in entry.to_pylist()], bool), *floats]


def atr_stops(bars: DataFrame, distance: float = 3.0, trail: bool = True, rows: int = ROWS) -> DataFrame:
    """bars (symbol, ts, entry, low, close, atr) with `position` 1 or 0 after each bar, the `stop` then, and `exit` 1 where the stop was met.

    On each bar a held position is out where low is below the stop; a flat one is in where `entry` holds, with a stop `distance` ranges below the
    close; with `trail` a held stop follows the close upwards. After an exit the next entry comes on a later bar. A bar without low meets no stop, one
    without close or atr starts and moves none. (symbol, ts) must not repeat.
    """
    placed = with_position(bars.select("symbol", "ts", *COLUMNS), rows).withColumn("segment", F.floor(F.col("_pos") / rows))
    packed = placed.groupBy("symbol", "segment").agg(F.sort_array(F.collect_list(F.struct("_pos", "ts", *COLUMNS))).alias("s"))
    table = stored(packed.select("symbol", "segment", *[F.col(f"s.{c}").alias(c) for c in ("ts", *COLUMNS)]), "stop-segments")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stop_map(*_arrays(batch, k), distance, trail) for k in range(batch.num_rows)]
            number = lambda v: None if v != v else float(v)
            columns = [pa.array([number(f[0]) for f in found], pa.float64()), pa.array([[float(x) for x in f[1]] for f in found], pa.list_(pa.float64())),
                       pa.array([[number(x) for x in f[2]] for f in found], pa.list_(pa.float64())), pa.array([number(f[3]) for f in found], pa.float64()),
                       pa.array([bool(f[4]) for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("segment"), *columns], ["symbol", "segment", "flat", "lows", "afters", "raised", "done"])

    told = table.mapInArrow(maps, "symbol string, segment long, flat double, lows array<double>, afters array<double>, raised double, done boolean")
    before = Window.partitionBy("symbol").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    listed = told.withColumn("maps", F.collect_list(F.struct("flat", "lows", "afters", "raised", "done")).over(before)).select("symbol", "segment", "maps")

    def through(stop, m):
        met = F.size(F.filter(m["lows"], lambda x: x >= stop))
        # lows fall: the first below the stop comes after all that are not
        held = F.when(met < F.size(m["lows"]), F.try_element_at(m["afters"], (met + 1).cast("int"))).when(m["done"], m["raised"]).otherwise(F.greatest(stop, m["raised"]))
        return F.when(stop.isNull(), m["flat"]).otherwise(held)

    begun = table.join(listed.withColumn("start", F.aggregate("maps", F.lit(None).cast("double"), through)).drop("maps"), ["symbol", "segment"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                entry, low, close, atr = _arrays(batch, k)
                held, stops, exits, _ = replay(entry, low, close, atr, distance, trail, batch.column("start")[k].as_py())
                n = len(low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("symbol")[k].as_py()] * n, pa.string()), batch.column("ts")[k].values, pa.array(held.astype("i4")),
                     pa.array(stops, pa.float64(), from_pandas=True), pa.array(exits.astype("i4"))], ["symbol", "ts", "position", "stop", "exit"])

    kind = table.schema["ts"].dataType.elementType.simpleString()
    after = begun.select("symbol", "ts", *COLUMNS, "start").mapInArrow(states, f"symbol string, ts {kind}, position int, stop double, exit int")
    return bars.join(after, ["symbol", "ts"])
