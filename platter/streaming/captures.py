"""Captured sectors as a stream: of the copies of a sector that keep arriving, the first valid one is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "disk string, track int, sector int, attempt int, valid boolean, data binary, at timestamp"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of captures, as they appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def recovered(captures: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each sector once, the first valid copy that arrives; the state of a sector is dropped when copies are later than `late`."""
    return captures.where("valid").withWatermark("at", late).dropDuplicatesWithinWatermark(["disk", "track", "sector"])


def progress(captures: DataFrame, per: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Attempts and valid ones by disk and window."""
    return captures.withWatermark("at", late).groupBy(F.window("at", per), "disk").agg(F.count("*").alias("attempts"), F.sum(F.col("valid").cast("long")).alias("valid"))
