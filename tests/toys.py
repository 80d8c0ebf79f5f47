"""Small hand-made series."""

import datetime as dt
import random

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double"


def bars(spark, closes, volumes=None, spread=0.0):
    """Bars from {symbol: closes}; rows are shuffled so that nothing relies on input order."""
    rows = []
    for symbol, values in closes.items():
        for i, c in enumerate(values):
            v = float((volumes or {}).get(symbol, [10.0] * len(values))[i])
            low, high = (None, None) if c is None else (c - spread, c + spread)
            rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), c, high, low, c, v, None if c is None else v * c))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=0, start=100.0):
    r, x, out = random.Random(seed), start, []
    for _ in range(n):
        x = max(1.0, x + r.gauss(0, 1))
        out.append(x)
    return out


def column(df, name, symbol="A"):
    return [r[name] for r in df.filter(f"symbol = '{symbol}'").orderBy("ts").select(name).collect()]
