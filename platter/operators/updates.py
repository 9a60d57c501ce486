"""Paths and requests against a table of entries (path, parent, name, is_dir, size): lookups, orders of listings, what each
volume's rules answer to a deletion, a rename or a comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import with_rank

#: Longest names and comments in Latin-1 bytes; fixed values of the formats.
NAME_LIMITS = {"ffs": 30, "ffs_long": 109, "pfs": 107, "fat": 255}
COMMENT_LIMIT = 79


def lookup(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """wanted, found, is_dir, size for requests (wanted): the entry of that very path, else the first one that differs by case only;
    nulls where there is none, so also where a part in the middle is a file. A join by the folded path, whatever the depth."""
    e = entries.select("path", "is_dir", "size")
    met = requests.select("wanted").distinct().join(e, F.lower("wanted") == F.lower("path"), "left")
    best = F.min(F.when(F.col("path").isNotNull(), F.struct((F.col("path") != F.col("wanted")).alias("inexact"), "path", "is_dir", "size")))
    return met.groupBy("wanted").agg(best.alias("x")).select("wanted", F.col("x.path").alias("found"), "x.is_dir", "x.size")


def placed(entries: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """entries with their place, from 1, among those of their directory. The order is one over all directories, sorted by ranges,
    so a directory of any size is nobody's single task."""
    ranked = with_rank(entries, "parent", *order, name="__rank")
    first = ranked.groupBy("parent").agg(F.min("__rank").alias("__first"))
    return ranked.join(first, "parent").withColumn(name, F.col("__rank") - F.col("__first") + 1).drop("__rank", "__first")


def deletions(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """What each kind of volume answers to requests (path) to delete one entry, and how many entries lose their directory where it
    goes although it is not empty: FFS ignores what is missing and asks for no empty directory; PFS3 refuses both; FAT ignores
    what is missing and refuses directories that are not empty."""
    held = entries.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n"))
    met = requests.join(entries.select("path", F.lit(True).alias("there")), "path", "left").join(held, "path", "left")
    missing, full = F.col("there").isNull(), F.coalesce(F.col("n"), F.lit(0)) > 0
    answer = lambda absent, kept: F.when(missing, absent).when(full, kept).otherwise("deleted")
    return met.select("path", answer("ignored", "deleted").alias("ffs"), answer("not found", "not empty").alias("pfs"), answer("ignored", "not empty").alias("fat"), F.when(missing, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("orphans"))


def name_check(name: Column, volume: str) -> Column:
    """Whether a volume (a key of NAME_LIMITS) takes a name, else why not."""
    held = F.translate(name, "/:\\" if volume == "fat" else "/:", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "empty").when(held != name, "separator").when(F.char_length(name) > NAME_LIMITS[volume], "too long").otherwise("ok")


def comment_check(comment: Column, long_names: Column) -> Column:
    """Volumes with long names keep them where others keep comments, and so take none."""
    return F.when(long_names, "unsupported").when(F.char_length(comment) > COMMENT_LIMIT, "too long").otherwise("ok")
