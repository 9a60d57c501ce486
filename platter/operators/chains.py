"""Linked lists in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settled


def hops(links: DataFrame, most: int = 40) -> DataFrame:
    """node, root, hop: the head of each node's list and its distance from it. links: node, next (null at the end); a node has at
    most one predecessor. Pointers back double their reach with each join, so a list of n nodes takes log n joins, and no
    recursion limit applies. Nodes of a closed ring have no head and are left out; no list of n nodes needs more than log n + 1
    joins, so a ring costs no more either."""
    back = links.where("next is not null").select(F.col("next").alias("node"), F.col("node").alias("before"))
    heads = links.select("node").join(back.select("node"), "node", "left_anti").select(F.col("node").alias("root"))
    now = settled(links.select("node").join(back, "node", "left").select("node", F.coalesce("before", "node").alias("up"), F.col("before").isNotNull().cast("long").alias("hop")), "chain")
    for _ in range(min(most, now.count().bit_length() + 1)):
        via = now.select(F.col("node").alias("up"), F.col("up").alias("over"), F.col("hop").alias("more"))
        after = settled(now.join(via, "up").select("node", F.col("over").alias("up"), (F.col("hop") + F.col("more")).alias("hop"), (F.col("over") != F.col("up")).alias("moved")), "chain")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return now.join(heads, F.col("up") == F.col("root"), "left_semi").select("node", F.col("up").alias("root"), "hop")
