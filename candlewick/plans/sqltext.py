"""SQL building blocks for the oracle: the market views as CTEs and full-window rolling expressions."""

from __future__ import annotations


def _bars(source: str, order: str, volume: str, quote: str) -> str:
    return f"""SELECT symbol, ts, first(price ORDER BY {order}) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY {order}) AS close, CAST({volume} AS DOUBLE) AS volume, round({quote}, 2) AS quote_volume
    FROM ({source}) GROUP BY symbol, ts"""


SUPPLIER = _bars(
    "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, * FROM lineitem",
    "l_orderkey, l_linenumber, l_partkey, l_extendedprice", "sum(l_quantity)", "sum(l_extendedprice)")


def _orders(column: str) -> str:
    return _bars(f"SELECT CAST({column} AS VARCHAR) AS symbol, o_orderdate AS ts, o_totalprice AS price, o_orderkey "
                 "FROM orders JOIN customer ON o_custkey = c_custkey", "o_orderkey", "count(*)", "sum(price)")


SEGMENT = _orders("c_mktsegment")
NATION = _orders("c_nationkey")
EVENT = _bars("SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, ts AS at_ts, value AS price, event_id "
              "FROM events WHERE value > 0", "at_ts, event_id", "count(*)", "sum(price)")
TRADES = """SELECT event_id AS trade_id, ts, event_type AS symbol, value AS price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, user_id,
    CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events WHERE value > 0"""
ASSETS = """SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, round(abs(s_acctbal) * 20000, 2) AS market_cap_usd,
    round(round(abs(s_acctbal) * 20000, 2) * 5, 2) AS market_cap_brl,
    CASE WHEN s_suppkey % 3 <> 0 THEN round(abs(s_acctbal) * 30, 2) END AS daily_volume_brl,
    CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2008-06-01' + to_days(CAST(s_suppkey % 200 * 37 AS INTEGER)) END AS listing_date, s_acctbal > 0 AS is_active,
    n_name AS exchange, r_name AS sector, 'supplier' AS source, TIMESTAMP '2024-01-01' AS last_updated
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
DIRTY = f"""WITH keyed AS (SELECT *, date_diff('day', TIMESTAMP '1970-01-01', ts) + CAST(symbol AS BIGINT) * 7 AS k,
      CAST(symbol AS BIGINT) % 3 AS odd FROM ({SUPPLIER})),
    base AS (SELECT symbol, ts, open, CASE WHEN k % 53 = 1 AND odd = 1 THEN low * 0.5 ELSE high END AS high, low,
      CASE WHEN k % 29 = 3 THEN NULL WHEN k % 61 = 5 THEN close * 10 ELSE close END AS close,
      CASE WHEN k % 71 = 2 AND odd = 2 THEN -volume WHEN k % 37 = 4 THEN 0.0 ELSE volume END AS volume,
      quote_volume, k, odd FROM keyed)
    SELECT symbol, ts, open, high, low, close, volume, quote_volume FROM base
    UNION ALL SELECT symbol, ts, open, high, low, close, volume, quote_volume FROM base WHERE k % 97 = 0 AND odd = 0"""
GAPPY = f"""WITH b AS ({SUPPLIER}),
    days AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM b GROUP BY symbol)
    SELECT symbol, ts, open, high, low, close, volume, quote_volume FROM days LEFT JOIN b USING (symbol, ts)"""



def panel(bars: str) -> str:
    """Weekly aligned bars from a bar select; mirrors `operators.cleaning.panel`."""
    carried = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("open", "high", "low", "close"))
    return f"""WITH pb AS ({bars}), wk AS (SELECT symbol, date_trunc('week', pb.ts)::TIMESTAMP AS ts, arg_min(open, pb.ts) AS open,
      max(high) AS high, min(low) AS low, arg_max(close, pb.ts) AS close, sum(volume) AS volume, sum(quote_volume) AS quote_volume
      FROM pb GROUP BY symbol, date_trunc('week', pb.ts)),
    grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS ts FROM wk GROUP BY symbol),
    filled AS (SELECT symbol, ts, {carried}, coalesce(volume, 0) AS volume, coalesce(quote_volume, 0) AS quote_volume
      FROM grid LEFT JOIN wk USING (symbol, ts)
      WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT * FROM filled WHERE close IS NOT NULL"""


W = "(PARTITION BY symbol ORDER BY ts)"


def ctes(body: str, **named: str) -> str:
    """WITH clause from named selects followed by `body`."""
    return body if not named else "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in named.items()) + "\n" + body


def frame(n: int, by: str = "symbol", order: str = "ts") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, by: str = "symbol", order: str = "ts") -> str:
    """agg(x) over the last n rows, NULL until all n are non-null. `agg` may hold a placeholder for x."""
    f = frame(n, by, order)
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"(CASE WHEN count({x}) {f} = {n} THEN {call} {f} END)"


def lag(x: str, n: int = 1, by: str = "symbol", order: str = "ts") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def tidy(x: str, digits: int = 6) -> str:
    """Presentation rounding with the tie-moving nudge."""
    return f"round(CAST({x} AS DOUBLE) + {10.0 ** -(digits + 3)!r}, {digits})"


def rnd(columns: str, digits: int = 6) -> str:
    return ", ".join(f"{tidy(c, digits)} AS {c}" for c in columns.split())


def decay(src: str, x: str, span: float | None = None, com: float | None = None, name: str = "e") -> dict[str, str]:
    """CTEs for the recursive form of the normalised decayed mean; result column `name` keyed by (symbol, ts)."""
    g = 1.0 - (2.0 / (span + 1.0) if span is not None else 1.0 / (1.0 + com))
    return {
        f"n_{name}": f"SELECT symbol, ts, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n "
                     f"FROM {src} WHERE {x} IS NOT NULL",
        f"r_{name}": f"SELECT symbol, ts, n, x AS s, CAST(1 AS DOUBLE) AS d FROM n_{name} WHERE n = 1 UNION ALL "
                     f"SELECT a.symbol, a.ts, a.n, a.x + {g!r} * r.s, 1 + {g!r} * r.d FROM r_{name} r "
                     f"JOIN n_{name} a ON a.symbol = r.symbol AND a.n = r.n + 1",
        f"v_{name}": f"SELECT symbol, ts, s / d AS {name} FROM r_{name}",
    }
