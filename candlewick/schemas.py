"""Table layouts. Every read states its schema; nothing is inferred from text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _D, _L, _TS, _B = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampNTZType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BARS = _struct(symbol=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, volume=_D, quote_volume=_D, source=_S)
ASSETS = _struct(
    symbol=_S, name=_S, market_cap_usd=_D, market_cap_brl=_D, daily_volume_brl=_D, listing_date=_TS,
    is_active=_B, exchange=_S, sector=_S, source=_S, last_updated=_TS, data_hash=_S,
)
POSITIONS = _struct(id=_L, symbol=_S, quantity=_D, avg_cost=_D, current_price=_D, market_value=_D,
                    unrealized_pnl=_D, ts=_TS)
TRADES = _struct(id=_L, symbol=_S, side=_S, quantity=_D, price=_D, amount=_D, fees=_D, ts=_TS, order_id=_S,
                 execution_status=_S)
PERFORMANCE = _struct(date=T.DateType(), total_value=_D, total_cost=_D, unrealized_pnl=_D, realized_pnl=_D,
                      daily_return=_D, cumulative_return=_D, sharpe_ratio=_D, max_drawdown=_D)
CHECK = _struct(check_name=_S, passed=_B, score=_D, message=_S, severity=_S)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Return `df` unchanged, or raise when one of `columns` is absent (plan time, no job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
