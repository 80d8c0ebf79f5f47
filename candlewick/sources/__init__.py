"""Readers, payload parsers, sinks and the market views built from the given tables."""
