"""Directories that paths imply: sums over them, and what is left without some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(path: str) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def rolled_up(files: DataFrame) -> DataFrame:
    """volume, dir, depth, items, bytes, largest of every directory of files (volume, path, size), the root (empty path) included.
    Files are summed by their own directory first, so only directories are counted once for each of those above them."""
    p = _parts("path")
    own = files.where(F.size(p) > 0).groupBy("volume", F.slice(p, F.lit(1), F.size(p) - 1).alias("at"))
    sums = own.agg(F.count("*").alias("items"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    above = F.transform(F.sequence(F.lit(0), F.size("at")), lambda i: F.struct(F.array_join(F.slice("at", F.lit(1), i), "/").alias("dir"), i.cast("long").alias("depth")))
    each = sums.select("volume", F.explode(above).alias("x"), "items", "bytes", "largest").select("volume", "x.*", "items", "bytes", "largest")
    return each.groupBy("volume", "dir", "depth").agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"))


def without(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """entries (path, ...) less those whose path or any directory above it is in gone (one column of paths, of any depth)."""
    gone = gone.toDF("__gone")
    p = _parts("path")
    upto = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    each = entries.where(F.size(p) > 0).select("path", F.explode(upto).alias("__gone"))
    hit = each.join(gone, "__gone", "left_semi").select("path").distinct()
    return entries.join(hit, "path", "left_anti")
