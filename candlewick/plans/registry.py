"""Registry of runnable queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_counts(sql: str) -> str:
    """Spell count_if as a counted CASE: the short form returns a 128-bit type in the oracle, a plain count does not."""
    name = "count_if("
    while (start := sql.find(name)) >= 0:
        depth, end = 1, start + len(name)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:start]}count(CASE WHEN {sql[start + len(name):end - 1]} THEN 1 END){sql[end:]}"
    return sql


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = plain_counts(sql)
