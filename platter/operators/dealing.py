"""Rows dealt out for work that costs much more than moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Partitions at most, so that the driver and the shuffle can keep account of them.
MOST = 20_000


def dealt(df: DataFrame, key: str, each: int) -> DataFrame:
    """df in partitions of about so many rows, by a key without hot values: small files and row groups hold many rows of costly
    work, and what a task holds at a time stays the same when the table grows. Partitions of a given number are not joined again."""
    return df.repartition(min(MOST, max(1, -(-df.count() // each))), key)
