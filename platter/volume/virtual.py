"""A virtual volume: the corpus tables as files. Columns: volume, path, size, and content where it is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents(docs: DataFrame) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")))
    return docs.select(F.lit("documents").alias("volume"), path.alias("path"), F.octet_length("text").cast("long").alias("size"))


def pages(table: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "")
    return table.select(F.lit("pages").alias("volume"), path.alias("path"), F.octet_length("html").cast("long").alias("size"))


def conversations(table: DataFrame) -> DataFrame:
    path = F.concat(F.lit("conv"), F.col("conv_id"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("_"), F.col("role"))
    return table.select(F.lit("conversations").alias("volume"), path.alias("path"), F.octet_length("text").cast("long").alias("size"))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def prefixes(files: DataFrame) -> DataFrame:
    """Each file once for every directory above it, the root (empty path) included: volume, dir, depth, path, size."""
    p = parts(F.col("path"))
    above = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.struct(F.array_join(F.slice(p, F.lit(1), i), "/").alias("dir"), i.alias("depth")))
    return files.select("volume", F.explode(above).alias("x"), "path", "size").select("volume", "x.dir", F.col("x.depth").cast("long").alias("depth"), "path", "size")


def tree(files: DataFrame) -> DataFrame:
    """All entries: directories that paths imply, once each, and files: volume, path, parent, name, is_dir, size, depth. A file
    that is also a directory of other files counts as the directory. (J17)"""
    p = parts(F.col("path"))
    each = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(F.array_join(F.slice(p, F.lit(1), i), "/").alias("path"), F.array_join(F.slice(p, F.lit(1), i - 1), "/").alias("parent"), F.element_at(p, i).alias("name"), (i < F.size(p)).alias("is_dir"), i.alias("depth")))
    rows = files.where(F.size(p) > 0).select("volume", "size", F.explode(each).alias("x"))
    # sums by path before the shuffle: a hot directory is one row for each task
    out = rows.groupBy("volume", "x.path", "x.parent", "x.name", "x.depth").agg(F.max("x.is_dir").alias("is_dir"), F.max(F.when(~F.col("x.is_dir"), F.col("size"))).alias("bytes"))
    return out.select("volume", "path", "parent", "name", "is_dir", F.when(F.col("is_dir"), 0).otherwise(F.coalesce("bytes", F.lit(0))).cast("long").alias("size"), F.col("depth").cast("long").alias("depth"))
