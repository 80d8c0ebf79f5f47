"""Queries over the given tables, one per operator of the inventory, with their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("indicators", "returns", "cleaning", "quality", "dependence", "regimes", "scoring", "tiers", "signals",
           "recommendations", "allocation", "execution", "performance", "backtests", "pairtrading", "learning",
           "reports", "files", "ingestion", "streams", "parity", "riskmodels")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"candlewick.plans.{name}")
