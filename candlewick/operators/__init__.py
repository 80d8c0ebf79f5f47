"""Operators: plain functions from DataFrame to DataFrame, keyed by symbol and time."""
