"""Tables on the shared storage that cut lineage: written once, read by every later step."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlewick.sources.files import scratch


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared scratch folder."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
