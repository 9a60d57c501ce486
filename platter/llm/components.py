"""Connected components and fixed-size membership filters, on tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, drop_table, mixed, table


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node that it reaches), for all nodes of edges (a, b: longs, any direction, repeats allowed).
    Alternates the two star steps until the edges stay the same; each is a minimum by node, summed map-side, and a join that
    can be split where a hub makes it uneven. Every step is written to the shared folder."""
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # every node keeps an edge to the least one; then the smaller neighbours of a node point at their least
        step = large.distinct()
        small = step.groupBy("u").agg(F.min("v").alias("m"))
        linked = step.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        after = table(linked.distinct(), "stars")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        if sign == mark:
            break
        now, mark = after, sign
    return after.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


#: Bits of a membership filter: its size is fixed, so it may be broadcast whatever the number of keys; too many keys only make
#: it let more rows through.
FILTER_BITS = 1 << 26


def _places(keys: np.ndarray) -> list[np.ndarray]:
    h = mixed(keys.view(np.uint64))
    return [h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS)]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = np.unique(np.concatenate(_places(b["key"].to_numpy())))
        yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["word", "w"])


class Member:
    """A Bloom filter with two hashes over long keys, built by the executors; what it rejects is certainly not a key."""

    def __init__(self, keys: DataFrame):
        """keys: one long column `key`."""
        spark = keys.sparkSession
        words = keys.transform(arrow(_bits, "word bigint, w bigint")).groupBy("word").agg(F.bit_or("w").alias("w"))
        found = words.toArrow()  # at most FILTER_BITS / 64 rows
        full = np.zeros(FILTER_BITS // 64, np.int64)
        full[found["word"].to_numpy()] = found["w"].to_numpy()
        self.bits: Broadcast = spark.sparkContext.broadcast(full)

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """For use inside Python functions: which of an array of keys may be in."""
        bits = self.bits

        def known(keys: np.ndarray) -> np.ndarray:
            full, ok = bits.value.view(np.uint64), np.ones(len(keys), bool)
            for p in _places(keys):
                ok &= (full[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
            return ok

        return known

    def sift(self, rows: DataFrame, key: str) -> DataFrame:
        """rows without those whose key is certainly none."""
        known = self.test()

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(known(b[key].to_numpy())))

        return rows.transform(arrow(keep, rows.schema))
