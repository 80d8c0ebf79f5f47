"""Training-data pipeline over documents: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and gives rows that are written as Parquet and read again.
All but the last return the columns of documents. Clean documents stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import decontaminate, packing, secrets, similar, toxicity
from candlewick.llm.queries import vocabulary
from candlewick.llm.shared import in_small_batches, stored, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def batched(stage: Stage) -> Stage:
    """The stage in a session whose tasks send texts to Python in small batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labelled rows of its folds of documents."""
    weights = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at a similarity of 0.8 or more by shingles of five words, the document with the smallest id."""
    return similar.keep_one_similar(docs, width=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind, and the character count brought up to date."""
    out = secrets.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, with ids, and their places in sequences."""
    return packing.packed(docs, vocabulary(), with_ids=True)


STAGES = [(name, batched(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_benchmark),
    ("secret_scans", mask_secrets), ("best_fit_packing", pack))]

#: Classifier, components and tokens are beyond SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that every stage keeps."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
