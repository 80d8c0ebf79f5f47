"""Shared steps of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from candlewick.functions.guards import rounded
from candlewick.plans.registry import register
from candlewick.plans.sqltext import SUPPLIER, ctes, tidy
from candlewick.sources.market import supplier_bars

Source = Callable[..., DataFrame]


def rowwise(name: str, operator: Callable[[DataFrame], DataFrame], columns: list[str], sql: str,
            source: Source = supplier_bars, bars: str = SUPPLIER, digits: int = 6, tidied: bool = False, **named: str) -> None:
    """Register an operator that adds `columns` to bars, `tidied` by itself or else here; `sql` selects (symbol, ts, columns) from CTE `bars`."""

    def run(spark, sf_dir):
        found = operator(source(spark, sf_dir)).select("symbol", "ts", *columns)
        return found if tidied else rounded(found, digits)

    outer = ", ".join(f"{tidy(c, digits)} AS {c}" if c not in INTS else c for c in columns)
    register(name, run, ctes(f"SELECT symbol, ts, {outer} FROM ({sql})", bars=bars, **named))


INTS: set[str] = set()


def whole(*columns: str) -> None:
    """Name columns that are not doubles and stay unrounded in `rowwise` oracles."""
    INTS.update(columns)
