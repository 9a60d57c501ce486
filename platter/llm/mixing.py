"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

1. Targets. Sources in code-point order (null last) have weights that repeat a given cycle. They share `volume` times all
   words; a target stops at `most` times its source's size and the excess is shared again by weight.
2. Blocks. The words of a source, its documents in the order of a keyed hash, are cut into blocks of nearly equal length. A
   target is a number of block instances: every block as often as the target holds the whole source, one more instance of the
   first blocks of a keyed permutation, and the beginning of the next one. As the lengths of blocks differ by a word at most,
   a source's words differ from its target by at most one word a block.
3. Splitting tree. The block instances of all sources are divided among the output shards: at each node the share of the left
   half is drawn from a multivariate hypergeometric distribution, so that quotas are exact at every level, and the two halves
   are split again, down to the shards.
4. A shard's blocks of a source are the next ones of the source's permutation, hence disjoint; inside a shard a keyed hash
   gives the order. The mix lies by shard in that order; a document that two blocks share stays whole in the shard of its first. Permutations are Feistel networks with cycle walking: no list of blocks is ever sorted or held.

Only totals by source reach the driver (checked against MOST_SOURCES); the offsets of documents inside a source are sums over
bins of the hash, so the hot source is spread over as many tasks as the rest.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, the last; null
ids and repeated rows keep a row each; a table without words takes nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, arrow, bounded_batches, flat, table, word_spans

WEIGHTS = (5.0, 2.0, 1.0)
VOLUME, MOST_REPEATS = 1.5, 2.0
BLOCK_WORDS = 1024
#: Bins of the hash order for each source, for the sums that give a document its offset.
BINS = 4096
MOST_SOURCES = 1_000_000
#: Output shards: at least FEWEST_SHARDS, and so many that none holds more than about SHARD_WORDS words, as long as the table of
#: quotas has at most MOST_QUOTAS numbers; with more sources shards get larger instead.
FEWEST_SHARDS, SHARD_WORDS, MOST_QUOTAS = 64, 1 << 26, 1 << 24


def shares(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets by weight, none above most x its size; the excess goes to the others by weight until none is above."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, most * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
        left = max(left, 0.0)
    return target


def splitting_tree(blocks: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Quotas [source, shard] whose sums by source are exactly `blocks` and by shard differ by at most one: recursive draws
    without replacement from what the node holds."""
    quotas = np.zeros((len(blocks), n_shards), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    total = int(blocks.sum())
    ends = [total * k // n_shards for k in range(n_shards + 1)]
    todo = [(0, n_shards, blocks.astype(np.int64))]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            quotas[:, lo] = held
            continue
        mid = (lo + hi) // 2
        need, rest, taken = ends[mid] - ends[lo], int(held.sum()), np.zeros(len(held), np.int64)
        for i in np.flatnonzero(held):  # a multivariate draw is a chain of univariate ones
            own = int(held[i])
            rest -= own
            if need == 0:
                break
            taken[i] = need if rest == 0 else _hypergeometric(rng, own, rest, need)
            need -= int(taken[i])
        todo += [(mid, hi, held - taken), (lo, mid, taken)]
    return quotas


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad  # beyond the generator's range the normal limit is exact to well under one part in 10^4 of the spread
    spread = (sample * (good / n) * (bad / n) * ((n - sample) / max(n - 1, 1))) ** 0.5
    return int(min(max(round(rng.normal(sample * good / n, spread)), sample - bad, 0), good, sample))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 to size-1 at each index: a balanced Feistel network, walked until it is in range."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    n, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        v, h, m = x[todo], half[todo], mask[todo]
        left, right = v >> h, v & m
        for turn in range(4):
            f = (right + key[todo] + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def plan(sources: list[tuple[str | None, int]], seed: int, n_shards: int | None = None, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, most: float = MOST_REPEATS) -> list[dict]:
    """For each source: size, target, blocks, block instances and its cumulative quotas over the shards."""
    sources = sorted(sources, key=lambda s: (s[0] is None, [*map(ord, s[0] or "")]))
    sizes = [int(n) for _, n in sources]
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], volume * sum(sizes), most)
    out = []
    for i, ((name, size), target) in enumerate(zip(sources, targets, strict=True)):
        n = -(-size // BLOCK_WORDS)
        whole = int(target * n / size) if size else 0
        tail = round(target - whole * size / n) if size else 0
        out.append({"source": name, "code": i, "source_size": size, "target": float(target), "n_blocks": n, "instances": whole, "tail": tail})
    n_shards = n_shards or max(FEWEST_SHARDS, min(-(-int(sum(targets)) // SHARD_WORDS), MOST_QUOTAS // max(len(sources), 1)))
    quotas = splitting_tree(np.array([s["instances"] + (s["tail"] > 0) for s in out], np.int64), n_shards, seed)
    for s, row in zip(out, quotas, strict=True):
        s["upto"] = [int(x) for x in np.cumsum(row)]
    return out


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long")))


def order_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def mix(docs: DataFrame, seed: int = 20240607, n_shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks). documents: doc_id, source, size, h and twin (a key: the hash that orders a source, and a number among
    equal rows), source_size, target, and `at`, the offset of its first word in its source. blocks: one row for each block
    instance: code, block, copy, shard, order, start, end (words of the source)."""
    spark = docs.sparkSession
    light = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).select("doc_id", "source", "size", order_key(seed).alias("h"))
    light = table(light, "sizes")
    totals = light.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    planned = plan([(r["source"], r["n"]) for r in totals], seed, n_shards)
    known = "code int, source string, source_size bigint, target double, n_blocks bigint, instances bigint, tail bigint"
    facts = spark.createDataFrame([(s["code"], s["source"], s["source_size"], s["target"], s["n_blocks"], s["instances"], s["tail"]) for s in planned], known)
    binned = light.withColumn("bin", F.shiftrightunsigned("h", 64 - (BINS.bit_length() - 1)).cast("int"))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = bins.select("source", "bin", (F.sum("n").over(W.partitionBy("source").orderBy("bin")) - F.col("n")).alias("before"))
    w = W.partitionBy("source", "bin").orderBy("h", "doc_id", "size")
    inside = binned.withColumn("inside", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("turn", F.row_number().over(w))
    inside = inside.withColumn("twin", F.col("turn") - F.min("turn").over(W.partitionBy("source", "bin").orderBy("h").rangeBetween(0, 0)))
    placed = inside.join(before, (inside["source"].eqNullSafe(before["source"])) & (inside["bin"] == before["bin"]), "left")
    placed = placed.select(inside["doc_id"], inside["source"], "size", "h", "twin", (F.coalesce("before", F.lit(0)) + F.col("inside")).alias("at"))
    documents = placed.join(F.broadcast(facts), placed["source"].eqNullSafe(facts["source"]), "left").select(placed["doc_id"], placed["source"], "size", "h", "twin", "at", "code", "source_size", "target", "n_blocks")
    return documents, _instances(facts, planned, seed)


def _instances(facts: DataFrame, planned: list[dict], seed: int) -> DataFrame:
    upto = {s["code"]: np.array(s["upto"], np.int64) for s in planned}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, block, n, size, whole, tail = (b[c].to_numpy() for c in ("code", "block", "n_blocks", "source_size", "instances", "tail"))
            instances = whole + (tail > 0)
            turn = permuted(block, n, np.array([seed], np.uint64) ^ (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            for copy in range(int((-(-instances // np.maximum(n, 1))).max(initial=0))):
                nth = copy * n + turn  # the place among the source's instances
                has = nth < instances
                c, at = code[has], nth[has]
                shard = np.zeros(len(c), np.int32)
                for k in np.unique(c):
                    shard[c == k] = np.searchsorted(upto[int(k)], at[c == k], "right")
                lo, hi = (_cut(block[has] + x, n[has], size[has]) for x in (0, 1))
                hi = np.where(at == whole[has], np.minimum(hi, lo + tail[has]), hi)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(block[has]), pa.array(np.full(len(c), copy, np.int32)), pa.array(shard), pa.array(lo), pa.array(hi)], ["code", "block", "copy", "shard", "start", "end"])

    blocks = facts.where("n_blocks > 0")
    spread = blocks.select("code", "n_blocks", "source_size", "instances", "tail", F.explode(F.expr(f"sequence(0L, (n_blocks - 1) div {BLOCK_RUN})")).alias("run")).repartition("code", "run")
    spread = spread.select("code", "n_blocks", "source_size", "instances", "tail", F.explode(F.expr(f"sequence(run * {BLOCK_RUN}, least(n_blocks, (run + 1) * {BLOCK_RUN}) - 1)")).alias("block"))
    placed = spread.transform(arrow(place, "code int, block bigint, copy int, shard int, start bigint, end bigint"))
    return placed.withColumn("order", F.xxhash64(F.lit(seed), "code", "block", "copy"))


#: Blocks that one row of the first explode stands for.
BLOCK_RUN = 4096


def _cut(block: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where a block begins: floor(block x size / n), without overflow."""
    return block * (size // n) + block * (size % n) // n


def spans(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """What the mix takes: a row for each piece of a document in a block instance: doc_id, h, twin, source, code, block, copy,
    shard, order, first and stop (words of the document)."""
    cut = lambda k: f"({k}) * (source_size div n_blocks) + (({k}) * (source_size % n_blocks)) div n_blocks"
    guess = "cast(floor(cast({} as double) * n_blocks / source_size) as bigint)"
    d = documents.where("size > 0").withColumn("lo", F.expr(f"greatest(0L, {guess.format('at')} - 1)")).withColumn("hi", F.expr(f"least(n_blocks - 1, {guess.format('(at + size - 1)')} + 1)"))
    each = d.withColumn("block", F.explode(F.sequence("lo", "hi"))).where(f"{cut('block')} < at + size and {cut('block + 1')} > at")
    # the planner takes the exploded blocks for a few rows; they grow with the words, so they must not be broadcast
    met = each.join(blocks.hint("merge"), ["code", "block"]).withColumn("first", F.expr("greatest(start, at) - at")).withColumn("stop", F.expr("least(end, at + size) - at"))
    return met.where("stop > first").select("doc_id", "h", "twin", "source", "code", "block", "copy", "shard", "order", "first", "stop")


def digest(docs: DataFrame, seed: int = 20240607) -> DataFrame:
    """Per document: size, its source's size and target, the words that the mix takes of it, the number of shards that hold
    some of them, and the first and the last of those shards."""
    documents, blocks = mix(docs, seed)
    documents = table(documents, "placed")
    taken = spans(documents, blocks).groupBy("code", "h", "twin").agg(F.sum(F.col("stop") - F.col("first")).alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    found = documents.join(taken, ["code", "h", "twin"], "left")
    return found.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "n_shards")), "first_shard", "last_shard")


def shards(docs: DataFrame, seed: int = 20240607) -> DataFrame:
    """The mix itself, without texts: each piece with its shard and, within the shard, the place of its block in the local
    shuffle; pieces of a block follow the source's order."""
    documents, blocks = mix(docs, seed)
    pieces = spans(documents, blocks)
    return pieces.withColumn("slot", F.row_number().over(W.partitionBy("shard").orderBy("order", "code", "block", "copy", "h", "twin", "first")))


#: A piece of the mix: the document's row and key, its text, and its place: shard, the block's place there, copy and first word.
_PIECES = ["row", "text", "h", "twin", "shard", "order", "copy", "first"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = flat(b["text"])
        at: list[int] = []
        texts: list[str] = []
        where: list[tuple[int, int, int, int]] = []
        for i, found in enumerate(b["found"].to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]]
            start, end, _ = word_spans(raw, np.array([0, len(raw)]))
            runs: list[list[int]] = []
            for copy, first, stop, shard, order in sorted((x["copy"], x["first"], x["stop"], x["shard"], x["order"]) for x in found):
                if runs and runs[-1][0] == copy and runs[-1][2] == first:
                    runs[-1][2] = stop
                else:
                    runs.append([copy, first, stop, shard, order])
            for copy, first, stop, shard, order in runs:
                whole = first == 0 and stop == len(start)
                lo, hi = (0, len(raw)) if whole else (int(start[first]), int(end[stop - 1]))
                at.append(i)
                texts.append(raw[lo:hi].tobytes().decode())
                where.append((shard, order, copy, first))
        if at:
            k = pa.array(at)
            shard, order, copy, first = (pa.array(x, t) for x, t in zip(zip(*where, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True))
            yield pa.RecordBatch.from_arrays([b["row"].take(k), pa.array(texts, pa.string()), b["h"].take(k), b["twin"].take(k), shard, order, copy, first], _PIECES)


def mixed_texts(docs: DataFrame, seed: int = 20240607) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each run of words that it takes of a document in one copy, the
    whole text where the run is the whole document, with n_chars, if there is one, of the text as it is then. Rows lie by shard,
    and in a shard in the order of the local shuffle."""
    return placed_texts(docs, seed).select(*docs.columns)


def placed_texts(docs: DataFrame, seed: int = 20240607) -> DataFrame:
    """mixed_texts with the pieces' places: mix_shard and mix_slot, which grows with the place in the shard."""
    bounded_batches(docs.sparkSession)
    # numbering equal rows deals the texts by h; the join by (h, twin) may then stay on that
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    documents, blocks = mix(docs, seed)
    taken = spans(documents, blocks).groupBy("h", "twin").agg(F.collect_list(F.struct("copy", "first", "stop", "shard", "order")).alias("found"))
    twin = F.row_number().over(W.partitionBy("h").orderBy("h")) - 1
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"), "source").withColumn("h", order_key(seed)).withColumn("twin", twin)
    met = rows.join(taken.hint("merge"), ["h", "twin"]).select("row", "text", "h", "twin", "found")
    kinds = (met.schema["row"].dataType, T.StringType(), T.LongType(), met.schema["twin"].dataType, T.IntegerType(), T.LongType(), T.IntegerType(), T.LongType())
    out = met.transform(arrow(_pieces, T.StructType([T.StructField(c, kind) for c, kind in zip(_PIECES, kinds, strict=True)])))
    # a shard in one task: it has at most about SHARD_WORDS words
    out = out.repartition("shard").sortWithinPartitions("shard", "order", "copy", "h", "twin", "first")
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*((changed[c] if changed.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns), F.col("shard").alias("mix_shard"), F.col("order").alias("mix_slot"))
