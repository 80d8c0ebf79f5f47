"""Small helpers of this subpackage: tables on shared storage, narrow inputs and Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.sources.files import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; whatever else the table holds, clashing names included, is left behind."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


_PASSING: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table on the shared storage, so that a lost executor costs no more than a read. Inside `passing` the table goes with its end."""
    path = scratch(df.sparkSession, label)
    if _PASSING:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Shuffles and broadcasts that no table needs any more go now, and with them the driver's memory; else they stay until its heap is full."""
    spark.sparkContext._jvm.System.gc()


def few_files(df: DataFrame) -> DataFrame:
    """Rows that an aggregate has just dealt evenly, one a key, in fewer partitions: some for each core, or an eighth of the session's.

    Each file that a task writes to a local folder starts processes, and a process that just starts counts the executor's memory twice.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def in_small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts go to Python so many at a time, or fewer if the session says so: both ends hold whole batches, and 10000 texts are tens of MB a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:  # none or less is no bound
        spark.conf.set(name, str(rows))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes inside are removed at the end; what is still read later must be stored outside."""
    paths: list[str] = []
    _PASSING.append(paths)
    try:
        yield
    finally:
        _PASSING.remove(paths)
        for path in paths:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """A stored table that outlives the innermost `passing`."""
    inner = _PASSING.pop() if _PASSING else None
    try:
        return stored(df, label)
    finally:
        if inner is not None:
            _PASSING.append(inner)


def learning_fold(key: str, folds: int, held: int) -> Column:
    """True for rows that may be learned from: crc32 of the id as text, modulo folds, is not the held remainder."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds != held


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows at most, picked by a hash of the key: the same rows on every run and every layout."""
    share = min(1.0, bound / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(share * 1_000_000))


def utf8(column: pa.Array) -> list[bytes]:
    """Values as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text; a single longer text is a batch of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        first, held = 0, 0
        lengths = pa.compute.binary_length(batch.column(at)).fill_null(0).to_pylist()
        for row, size in enumerate(lengths):
            if row > first and held + size > most:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if batch.num_rows > first:
            yield batch.slice(first)
