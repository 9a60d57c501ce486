"""Positions in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import settled


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its position from 0 in the order: rows are range-partitioned and sorted, the place inside a partition comes from
    the row number there, and the sizes of the partitions before it, a row for each partition, are added. Ties should be
    broken by the order itself; if not, they are in any order, but each position is given once."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settled(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__inside": inside}), "ranked")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def with_sum(df: DataFrame, value: str, *order: Column | str, name: str = "before") -> DataFrame:
    """df with the sum of a column over all rows before it in the order. Inside a range of the order a window gives it, and the
    sums of the ranges before, a row for each partition, are added."""
    placed = settled(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "summed")
    sums = placed.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = sums.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.sum(value).over(W.partitionBy("__part").orderBy("__at")) - F.col(value)
    return placed.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__at", "__inside", "__before")


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers: keys, first, last, n. Values are distinct within a key. In a run value and rank grow alike;
    the rank is one over all keys, so a hot key is spread over ranges."""
    return with_rank(df, *keys, value, name="__rank").withColumn("__run", F.col(value) - F.col("__rank")).groupBy(*keys, "__run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__run")
