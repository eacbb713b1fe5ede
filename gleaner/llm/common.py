"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
BROADCAST_ROWS = 100_000  # of one id or hash: below 2 MB


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not in the one column of ``gone``; rows with a null there stay.

    ``gone`` is a written table of distinct values.  Up to BROADCAST_ROWS of
    them are broadcast, so that the rows are not shuffled.
    """
    few = gone.count() <= BROADCAST_ROWS
    named = gone.toDF("__gone")
    return rows.join(F.broadcast(named) if few else named, rows[column] == named["__gone"], "left_anti")


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each hold about ``limit`` bytes (one row at least).

    At the end Arrow's pool gives back what it holds free: the worker stays for
    later tasks, and an executor counts its idle workers too.
    """
    for batch in batches:
        sizes = [0 if s is None else s for s in pa.compute.binary_length(batch.column(text)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
