"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the driver runs all tasks itself, as in tests, a temporary
    one that is set from then on. On a cluster it must be set."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if (kept := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return kept.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(made := tempfile.mkdtemp(prefix="platter-"))
    return f"file://{made}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: what is random or costly in it is decided once, and lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/platter/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
