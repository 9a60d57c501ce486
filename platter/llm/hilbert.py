"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is quantised to BITS bits; the curve index of a row's cell orders the rows, and runs of equal length along it
are the shards. A run touches few cells, and neighbouring cells differ by one step in one dimension, so a file's minima and
maxima of every dimension stay narrow and readers skip most files.

Cost: the texts are read once and never shuffled. What is sorted is a row of ids and small numbers; ties on the curve are
broken by the text's checksum and the id, so equal texts of a cell stay together and no cell, however hot, is one partition's
alone. Ranks come from the offset inside a sorted partition plus the sizes of the partitions before it, a table with a row
for each partition.

Defined results: a null or empty text has 16 bytes (the overhead) and checksum 0; null dimensions take cell 0; null ids sort
first; repeated rows get places of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

BITS = 6
OVERHEAD = 16
N_SHARDS = 40


def category(c: Column, bits: int = BITS) -> Column:
    """A categorical dimension: a bucket of its hash, so that any number of values needs no dictionary; null is 0."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int"))


def magnitude(c: Column, steps: int = 3, bits: int = BITS) -> Column:
    """A numeric dimension: `steps` buckets for each doubling, up to the last one."""
    level = F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * steps).cast("int")
    return F.when(c.isNull(), F.lit(0)).otherwise(F.least(level, F.lit((1 << bits) - 1)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def curve_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a cell of len(dims) dimensions: the axes are rotated and reflected bit by bit from
    the top, Gray-coded, and their bits interleaved. Higher-order functions over one small array."""
    n = len(dims)
    at = lambda xs, i: F.get(xs, F.lit(i) if isinstance(i, int) else i)
    has = lambda x, q: x.bitwiseAND(q) != 0
    levels = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)))

    def turn(xs: Column, q: Column) -> Column:
        for i in range(n):
            xs = bound(xs, one_axis(q, i))
        return xs

    def one_axis(q: Column, i: int) -> Callable[[Column], Column]:
        def apply(a: Column) -> Column:
            swap = F.when(has(at(a, i), q), F.lit(0)).otherwise(at(a, 0).bitwiseXOR(at(a, i)).bitwiseAND(q - 1))
            return bound(swap, lambda s: F.array(*(_turned(a, q, s, i, j) for j in range(n))))

        return apply

    def _turned(a: Column, q: Column, swap: Column, i: int, j: int) -> Column:
        if j == 0:
            return F.when(has(at(a, i), q), at(a, 0).bitwiseXOR(q - 1)).otherwise(at(a, 0).bitwiseXOR(swap))
        return at(a, j).bitwiseXOR(swap) if j == i else at(a, j)

    def gray(xs: Column) -> Column:
        out = [at(xs, 0)]
        for j in range(1, n):
            out.append(out[-1].bitwiseXOR(at(xs, j)))
        return F.array(*out)

    def index(xs: Column) -> Column:
        mask = F.aggregate(levels, F.lit(0), lambda t, q: F.when(has(at(xs, n - 1), q), t.bitwiseXOR(q - 1)).otherwise(t))
        return bound(mask, lambda m: bound(F.transform(xs, lambda x: x.bitwiseXOR(m).cast("long")), interleaved))

    def interleaved(xs: Column) -> Column:
        return sum((F.shiftleft(F.shiftright(at(xs, i), b).bitwiseAND(1), b * n + n - 1 - i) for b in range(bits) for i in range(n)), F.lit(0).cast("long"))

    return bound(F.aggregate(levels, F.array(*(d.cast("int") for d in dims)), turn), lambda t: bound(gray(t), index))


def default_dims(size: Column) -> list[Column]:
    return [category(F.col("lang")), category(F.col("source")), magnitude(size)]


def measured(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 and the curve index of each document; with carry also the whole row as one struct, so that no
    name of it can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    row = [F.struct(*docs.columns).alias("row")] * carry
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), curve_index(default_dims(size)).alias("curve"), *row)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, carry: bool = False) -> DataFrame:
    """Every document's shard and slot. Law `rows`: the counts of the shards differ by at most one. With carry, the rows lie
    along the curve in the result, a column `row` holds the document, and the texts are shuffled once."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = table(measured(docs, carry).sort("curve", "text_crc32", "doc_id").withColumns({"part": F.spark_partition_id(), "inside": inside}), "curve")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition of the sort, so this window sees as many rows as the sort had tasks
    upto = W.orderBy("part")
    before = sizes.select("part", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    first = F.expr(f"(cast(shard as bigint) * total + {n_shards - 1}) div {n_shards}")  # the first rank of the shard
    return (
        placed.join(F.broadcast(before), "part")
        .withColumn("rank", F.col("before") + F.col("inside"))
        .withColumn("shard", F.expr(f"cast((rank * {n_shards}) div total as int)"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *["row"] * carry)
    )
