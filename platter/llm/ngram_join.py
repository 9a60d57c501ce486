"""Near duplicates by the Jaccard similarity of word shingles, with token-combination prefixes.

1. Every document becomes its set of distinct five-word shingles (64-bit hashes). Documents with equal sets are one node; from
   here on a node counts once, however many copies it has.
2. Tokens (shingles) have one global order: rare ones first, by hash, then frequent ones by frequency. If two sets reach the
   threshold, their prefixes of n - ceil(0.8 n) + k tokens have at least k tokens in common. A rare token of the prefix is
   indexed alone. Frequent tokens fall into g groups and are indexed as pairs within a group: with k = g + 1 common tokens, either
   one is rare or two of a group are common. g grows with the set, so that a set has about as many pairs as tokens. So a passage that many documents share, whose tokens are frequent
   and stand last, makes no large buckets. Very small sets have a tier of their own with single tokens.
   Frequency: each task counts tokens over runs of documents and reports those met at least twice in a run, so a token missed
   by all runs occurs at most once in each; any order gives whole results, it only decides the cost.
3. In a bucket each node is compared with one centre, not with all others. Links found give components, and from here on only
   pairs between components count. A bucket whose nodes fall in several components is cut into cells: some of its outsiders
   (nodes that are not of its largest component) and some of all its nodes, each so few that a cell is a small batch. A cell
   compares the bitmaps of its nodes. First each outsider tries its likeliest partner of each other component, which joins most
   of what belongs together; then all pairs left between components are verified. After that no link between components can be
   missed, so components are exact.
4. Every node has a bitmap of its tokens, 4 to 8 bits a token. Bits of one node that the other lacks are tokens that it lacks, so
   pairs with too many of them are out for certain. Verification of the rest compares whole sets: their texts are found through
   a membership filter of fixed size, and a centre meets its members in a stream, over as many tasks as its group needs.
5. All links lie inside components. To count them, each component is cut into slots of a bounded number of nodes and tokens, and
   every two slots meet in one cell, so each pair of nodes is compared once, whole sets against whole sets. A cell gives one sum a
   node, never its pairs. The work grows with the square of a component's different sets, copies not counted.

Defined results: a null or blank text has an empty set, n_shingles 0, and is its own component; fewer than five words give one
shingle of them all; null ids count as no id (a component of only null ids has null); repeated rows are equal sets, so they
link with each other; an empty set has 0 links; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, arrow, bounded_batches, chunks, drop_table, flat, mixed, table, word_spans
from .components import Member, components

SHINGLE = 5
THRESHOLD = (80, 100)
#: Sets of up to SMALL tokens are indexed by single tokens, sets of FROM or more with pairs of frequent ones; no partner of a
#: set below FROM is above SMALL.
SMALL, FROM = 15, 12
#: A token is frequent from FREQUENT sets on; the class holds MOST_FREQUENT tokens at most (8 bytes each), the most frequent.
FREQUENT, MOST_FREQUENT = 12, 2_000_000
#: Tokens that a counting run holds.
RUN = 3_000_000
#: Members that meet their centre in one task, and parts of a bucket of frequent tokens.
MEMBERS, PARTS = 2048, 16
#: About as many outsiders and as many nodes in a cell of a bucket. Larger buckets have more cells.
OUTSIDERS, NODES = 128, 256
#: Bytes of a bitmap in a cell: longer ones are or-ed into this length, which rules out less, but nothing wrongly. Buckets of
#: up to FEW nodes have few pairs anyway, and their bitmaps are compared later.
CELL_BITMAP, FEW = 256, 32
#: About as many nodes and tokens in a slot of a component; two slots meet in a cell. Columns that a cell multiplies together.
SLOT_NODES, SLOT_TOKENS, COLUMNS = 512, 500_000, 4096
#: Pairs that a pass over the cells of a batch looks at together.
PASS = 1 << 18

_ONE, _TWO, _PAIR = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def shingles(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document of a flat, lower-cased batch."""
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    words = mixed(Rolling(data).of(start, end) + (end - start).astype(np.uint64))
    first = np.searchsorted(doc, np.arange(n + 1))
    k = max(len(words) - SHINGLE + 1, 0)
    key = np.zeros(k, np.uint64)
    for i in range(SHINGLE):
        key = mixed(key + words[i : i + k])
    for d in range(n):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= SHINGLE:
            yield np.unique(key[lo : hi - SHINGLE + 1])
        elif hi > lo:
            h = np.zeros(1, np.uint64)
            for w in words[lo:hi]:
                h = mixed(h + w)
            yield mixed(h ^ np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def identity(tokens: np.ndarray) -> int:
    """A set's node: a hash of its tokens in any order and their number."""
    with np.errstate(over="ignore"):
        total = np.array([mixed(tokens ^ _ONE).sum(dtype=np.uint64) + np.uint64(len(tokens)) * _TWO], np.uint64)
    return int(mixed(total).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = flat(batch["text"], lower=True)
    for i, j in chunks(offsets):
        yield from shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: 0, a document: id, row key, node, size of its set; 1, a token met twice or more in a run: token, count."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    many = 0

    def counts() -> pa.RecordBatch:
        every = np.concatenate(held) if held else np.zeros(0, np.uint64)
        held.clear()
        every.sort()  # in place: this is the largest array of a worker
        same = np.flatnonzero(every[1:] == every[:-1])
        token, n = np.unique(every[same], return_counts=True)
        token, n = token.view(np.int64), n + 1
        return _rows(1, pa.nulls(len(n), pa.int64()), token, token, n, [None] * len(n))

    for batch in batches:
        node, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        bits: list[bytes | None] = [None] * batch.num_rows
        for i, tokens in enumerate(_sets(batch)):
            node[i], size[i] = identity(tokens), len(tokens)
            if len(tokens) and node[i] not in seen:
                seen.add(int(node[i]))
                bits[i] = bitmap(tokens)
                held.append(tokens)
                many += len(tokens)
                if many >= RUN:
                    yield counts()
                    seen.clear()
                    held.clear()
                    many = 0
        yield _rows(0, batch["doc_id"], batch["row_key"].to_numpy(), node, size, bits)
    yield counts()


def bitmap(tokens: np.ndarray) -> bytes:
    """Bit h mod m for each token h; m is the power of two of at least four bits a token. Half of a bitmap or-ed with the other
    half is the bitmap of half the length."""
    m = max(8, 1 << (4 * len(tokens) - 1).bit_length())
    full = np.zeros(m, bool)
    full[tokens & np.uint64(m - 1)] = True
    return np.packbits(full, bitorder="little").tobytes()


class Bitmaps:
    """Many bitmaps, as a matrix for each length."""

    def __init__(self, bits: pa.Array):
        raw = [x.as_buffer() for x in bits]
        self.length = np.fromiter(map(len, raw), np.int64, len(bits))
        self.row = np.zeros(len(bits), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.row[at] = np.arange(len(at))
            self.of[n] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint8).reshape(len(at), n)

    def lacking(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of rows: at least how many tokens of i are missing from j, and of j from i."""
        less, more = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        kinds = self.length[i] << 32 | self.length[j]
        for kind in np.unique(kinds).tolist():
            n, m = kind >> 32, kind & (1 << 32) - 1
            short = min(n, m)
            at = np.flatnonzero(kinds == kind)
            step = max(1, (4 << 20) // max(n, m))
            for part in (at[k : k + step] for k in range(0, len(at), step)):
                x, y = self.of[n][self.row[i[part]]], self.of[m][self.row[j[part]]]
                if n > short:
                    x = np.bitwise_or.reduce(x.reshape(len(x), -1, short), axis=1)
                if m > short:
                    y = np.bitwise_or.reduce(y.reshape(len(y), -1, short), axis=1)
                less[part] = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
                more[part] = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
        return less, more


def _needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many tokens two sets of these sizes must share to reach the threshold."""
    return -(-THRESHOLD[0] * (na + nb) // (THRESHOLD[0] + THRESHOLD[1]))


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.num_rows
        bits = Bitmaps(pa.concat_arrays([batch["bits_a"], batch["bits_b"]]))
        na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
        less, more = bits.lacking(np.arange(k), np.arange(k, 2 * k))
        inter = _needed(na, nb)
        yield batch.filter(pa.array((less <= na - inter) & (more <= nb - inter))).select(["a", "b"])


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that their bitmaps don't rule out. nodes: node, n, bits."""
    own = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b").transform(arrow(_plausible, "a bigint, b bigint"))


def _rows(kind: int, ids: pa.Array, key: np.ndarray, node: np.ndarray, n: np.ndarray, bits: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids.cast(pa.int64()), pa.array(key), pa.array(node), pa.array(n.astype(np.int64)), pa.array(bits, pa.binary())], ["kind", "doc_id", "row_key", "node", "n", "bits"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key"))


def frequent(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens in order and their counts: at most MOST_FREQUENT, by a threshold that a histogram gives."""
    counted = table(tokens.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    levels = sorted(((r["l"], r["c"]) for r in counted.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 4).alias("l")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, lowest = 0, None
    for level, c in levels:
        total += c
        if total > MOST_FREQUENT:
            break
        lowest = level
    if lowest is None:
        drop_table(counted)
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counted.where(F.floor(F.log2(F.col("n").cast("double")) * 4) >= lowest).toArrow()
    drop_table(counted)
    token, n = found["node"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def tier(n: int) -> int:
    """Sets of one tier use the same number of groups: 2^tier / 32. Sizes of up to 511 are one tier, then each doubling is."""
    return max(8, n.bit_length() - 1)


def signatures(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of one set, which of them are of frequent tokens, and how late in the order: the place of the last token
    less the k of the guarantee. tokens: sorted. hint: a table of bits that says
    which low bits frequent tokens have. Where partners can be of two tiers, the set is indexed under both."""
    n = len(tokens)
    spare = n - -(-THRESHOLD[0] * n // THRESHOLD[1])
    tiers = sorted({tier(-(-THRESHOLD[0] * n // THRESHOLD[1])), tier(n * THRESHOLD[1] // THRESHOLD[0])})
    need = min(n, spare + (1 << tiers[-1]) // 32 + 1 if n >= FROM else spare + 1)
    maybe = hint[tokens & np.uint64(len(hint) - 1)]
    often = np.zeros(n, np.int64)
    if maybe.any() and len(common):
        at = np.flatnonzero(maybe)
        found = np.minimum(np.searchsorted(common, tokens[at]), len(common) - 1)
        hit = common[found] == tokens[at]
        often[at[hit]] = counts[found[hit]]
    if often.any():
        order = np.lexsort((tokens, often))[:need]
        chosen, often = tokens[order], often[order]
    else:
        chosen, often = tokens[:need], often[:need]
    k = (1 << tiers[-1]) // 32 + 1
    place = np.arange(1, len(chosen) + 1)
    out, kind, late = [], [], []
    if n <= SMALL:
        few = chosen[: spare + 1]
        out.append(mixed(few ^ _ONE))
        kind.append(often[: spare + 1] > 0)
        late.append(place[: spare + 1] - 1)
    if n >= FROM:
        rare = chosen[often == 0]
        out.append(mixed(rare ^ _TWO))
        kind.append(np.zeros(len(rare), bool))
        late.append(place[often == 0] - k)
        for t in tiers:
            groups = (1 << t) // 32
            own = min(n, spare + groups + 1)
            hot, at = chosen[:own][often[:own] > 0], place[:own][often[:own] > 0]
            by = np.argsort(hot)
            hot, at = hot[by], at[by]
            group = ((hot >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            hot, at, edges = hot[order], at[order], np.searchsorted(group[order], np.arange(groups + 1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1:
                    a, b = np.triu_indices(hi - lo, 1)
                    out.append(mixed(mixed(hot[lo + a] ^ _PAIR ^ np.uint64(t)) + hot[lo + b]))
                    kind.append(np.ones(len(a), bool))
                    late.append(np.maximum(at[lo + a], at[lo + b]) - k)
    return np.concatenate(out), np.concatenate(kind), np.concatenate(late)


def index(docs: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """sig, part (of a bucket of frequent tokens), node, n, late: the buckets that each set is in."""
    shared = docs.sparkSession.sparkContext.broadcast((common, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        hint = np.zeros(1 << 22, bool)
        hint[often & np.uint64(len(hint) - 1)] = True
        seen: set[int] = set()
        for batch in batches:
            out = []
            for tokens in _sets(batch):
                if not len(tokens) or (node := identity(tokens)) in seen:
                    continue
                seen.add(node)
                sig, hot, late = signatures(tokens, often, times, hint)
                out.append((sig, hot, late.astype(np.int32), np.full(len(sig), node, np.int64), np.full(len(sig), len(tokens), np.int32)))
            if out:
                sig, hot, late, node, n = (np.concatenate(x) for x in zip(*out, strict=True))
                part = np.where(hot, 1 + (node & (PARTS - 1)), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(part), pa.array(node), pa.array(n), pa.array(late)], ["sig", "part", "node", "n", "late"])

    return docs.select("text").transform(arrow(run, "sig bigint, part int, node bigint, n int, late int"))


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of bucket, late and node: each node with its bucket's first one, which has the fewest rare tokens and
    so is the likeliest to be near all others. Buckets with one node go, but for
    those of frequent tokens, which are met again with their other parts. Only the bucket at hand is kept, as its centre."""
    last = None  # sig, part, node, n, late of the centre and whether it has been given out
    for b in batches:
        cols = [b[c].to_numpy() for c in ("sig", "part", "node", "n", "late")]
        if not b.num_rows:
            continue
        if last is not None:
            cols = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(last, cols, strict=False)]
        sig, part, node, n, late = cols
        head = np.ones(len(sig), bool)
        head[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
        fresh = head.copy()
        fresh[1:] |= node[1:] != node[:-1]
        if last is not None and last[5]:
            fresh[0] = False
        centre = np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))
        other = fresh & ~head
        has = np.zeros(len(sig), bool)
        has[centre[other]] = True
        give = other | (fresh & head & (has | (part > 0)))
        done = bool(has[centre[-1]] or part[-1] > 0 or (centre[-1] == 0 and last is not None and last[5]))
        c = centre[-1]
        last = (sig[c], part[c], node[c], n[c], late[c], done)
        at = np.flatnonzero(give)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[at], part[at], node[at], n[at], late[at], node[centre[at]], n[centre[at]], late[centre[at]])], ["sig", "part", "node", "n", "late", "centre", "cn", "clate"])


_STAR = "sig bigint, part int, node bigint, n int, late int, centre bigint, cn int, clate int"


def stars(rows: DataFrame) -> DataFrame:
    return rows.repartition("sig", "part").sortWithinPartitions("sig", "part", "late", "node").transform(arrow(_starred, _STAR))


def _common(na: str, nb: str) -> str:
    """How many tokens two sets of these sizes must share to reach the threshold."""
    return f"({THRESHOLD[0]} * ({na} + {nb}) + {THRESHOLD[0] + THRESHOLD[1] - 1}) div {THRESHOLD[0] + THRESHOLD[1]}"


def _pairs(a: str, b: str, na: str, nb: str, la: str, lb: str) -> str:
    """Two sets of a bucket that can reach the threshold by their sizes, and whose signature is among the first tokens that they
    must share: the first k common tokens of a pair stand among the first n - common + k of each, so a pair that is refused
    here for its places is met in another bucket, or reaches nothing."""
    return f"{a} <> {b} and {THRESHOLD[1]} * least({na}, {nb}) >= {THRESHOLD[0]} * greatest({na}, {nb}) and {la} <= {na} - {_common(na, nb)} and {lb} <= {nb} - {_common(na, nb)}"


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a: centre, b), those whose whole sets reach the threshold. nodes: node, row_key of one document."""
    parts = pairs.groupBy("a").agg(F.expr(f"(count(*) - 1) div {MEMBERS} + 1").alias("parts"))
    slot = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = pairs.join(parts, "a").select("a", F.col("b").alias("node"), slot.alias("slot"))
    centres = parts.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("slot"))
    wanted = members.unionByName(centres).groupBy("node").agg(F.collect_list(F.struct("a", "slot")).alias("at")).join(nodes, "node")
    wanted = table(wanted, "wanted")
    texts = Member(wanted.select(F.col("row_key").alias("key"))).sift(docs.select("row_key", "text"), "row_key")
    sets = texts.join(wanted.hint("merge"), "row_key").select("node", "text", "at").transform(arrow(_spread, "a bigint, slot int, member boolean, node bigint, tokens binary"))
    met = sets.repartition("a", "slot").sortWithinPartitions("a", "slot", "member")
    return met.transform(arrow(_compared, "a bigint, b bigint")).distinct()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "slot", "member", "node", "tokens"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    for batch in batches:
        node, at = batch["node"].to_pylist(), batch["at"].to_pylist()
        out: list[tuple] = []
        size = 0
        for i, tokens in enumerate(_sets(batch)):
            raw = tokens.tobytes()
            for x in at[i]:
                out.append((x["a"], x["slot"], x["a"] != node[i], node[i], raw))
                size += len(raw)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream in which each centre comes before its members; one set is kept."""
    at, centre = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, slot, member, node = (batch[c].to_pylist() for c in ("a", "slot", "member", "node"))
        found: list[tuple[int, int]] = []
        for i, raw in enumerate(batch["tokens"]):
            tokens = np.frombuffer(raw.as_buffer(), np.uint64)
            if not member[i]:
                at, centre = (a[i], slot[i]), tokens.copy()
            elif at == (a[i], slot[i]):
                where = np.minimum(np.searchsorted(centre, tokens), max(len(centre) - 1, 0))
                inter = int((centre[where] == tokens).sum())
                if THRESHOLD[1] * inter >= THRESHOLD[0] * (len(centre) + len(tokens) - inter):
                    found.append((a[i], node[i]))
            else:
                raise ValueError("a member came without its centre")
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def unsettled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are of several components: sig, node, n, late, comp, top (the largest component), size and
    outside (how many nodes are of other components). Buckets of two have had their only pair compared; `whole` counts a
    bucket's nodes before any were left out, since a centre that has gone compared the others with itself only."""
    held = members.join(comp, "node", "left").select("sig", "node", "n", "late", "whole", F.coalesce("comp", "node").alias("comp"))
    each = held.groupBy("sig", "comp").agg(F.count("*").alias("c"), F.max("whole").alias("whole"))
    most = each.groupBy("sig").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k"), F.sum("c").alias("size"), F.max("whole").alias("whole")).where("k > 1 and whole > 2")
    most = most.select("sig", F.col("top.comp").alias("top"), "size", (F.col("size") - F.col("top.c")).alias("outside"))
    return table(held.join(most, "sig"), "open")


_CELL = "a bigint, b bigint, other bigint, differ bigint"


def _in_cells(best: bool):
    """From rows in the order of cells, outsiders first: the pairs of nodes of different components that can reach the threshold
    by size, place and bitmap; other: the component of b, differ: at least how many tokens only one of the two has. best: of
    each outsider and other component in a cell only the pair that differs least. Cells are small, so a cell that an Arrow
    batch cuts is kept until the rest of it comes."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = rows.combine_chunks()
        sig, block, slot, node, n, late, comp = (whole[c].to_numpy() for c in ("sig", "block", "slot", "node", "n", "late", "comp"))
        outsider, stray = (whole[c].to_numpy() for c in ("outsider", "stray"))
        head = np.ones(len(sig), bool)
        head[1:] = (sig[1:] != sig[:-1]) | (block[1:] != block[:-1]) | (slot[1:] != slot[:-1])
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(sig))
        cell = np.cumsum(head) - 1
        outs = np.add.reduceat(outsider.astype(np.int64), start)
        x = np.flatnonzero(outsider)  # every outsider meets the members of its cell
        many = (end - start - outs)[cell[x]]
        raw = whole["bits"].chunk(0) if whole["bits"].num_chunks == 1 else pa.concat_arrays(whole["bits"].chunks)
        bits = Bitmaps(raw)
        upto = np.cumsum(many)
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PASS, "right")))
            k = many[at:stop]
            i = np.repeat(x[at:stop], k)
            j = np.repeat((start + outs)[cell[x[at:stop]]], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            at = stop
            small, large = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
            spare_i, spare_j = n[i] - _needed(small, large), n[j] - _needed(small, large)
            # two outsiders meet in two cells, and once is enough
            ok = (comp[i] != comp[j]) & (~stray[j] | (node[i] < node[j]))
            ok &= (THRESHOLD[1] * small >= THRESHOLD[0] * large) & (late[i] <= spare_i) & (late[j] <= spare_j)
            i, j, spare_i, spare_j = i[ok], j[ok], spare_i[ok], spare_j[ok]
            less, more = bits.lacking(i, j)
            ok = (less <= spare_i) & (more <= spare_j)
            i, j, differ = i[ok], j[ok], (less + more)[ok]
            if best and len(i):
                order = np.lexsort((node[j], differ, comp[j], i))
                first = np.ones(len(i), bool)
                first[1:] = (i[order][1:] != i[order][:-1]) | (comp[j][order][1:] != comp[j][order][:-1])
                i, j, differ = (v[order[first]] for v in (i, j, differ))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[i], node[j], comp[j], differ)], ["a", "b", "other", "differ"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*kept, b])
            last = [rows[c][-1].as_py() for c in ("sig", "block", "slot")]
            same = np.ones(rows.num_rows, bool)
            for c, v in zip(("sig", "block", "slot"), last, strict=True):
                same &= rows[c].to_numpy() == v
            cut = int(np.argmax(same))  # sorted, so the cell is the end of the rows
            if cut:
                yield from pairs(rows.slice(0, cut))
            kept = rows.slice(cut).combine_chunks().to_batches()
        if kept:
            yield from pairs(pa.Table.from_batches(kept))

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of at most CELL_BITMAP bytes."""
    for b in batches:
        raw = (np.frombuffer(x.as_buffer(), np.uint8) for x in b["bits"])
        short = [(np.bitwise_or.reduce(x.reshape(-1, CELL_BITMAP), axis=0) if len(x) > CELL_BITMAP else x).tobytes() for x in raw]
        yield b.set_column(b.schema.get_field_index("bits"), "bits", pa.array(short, pa.binary()))


def crossed(open_: DataFrame, nodes: DataFrame, best: bool) -> DataFrame:
    """Pairs between components that the buckets of open_ leave possible (see _in_cells). An outsider is in as many cells as
    its bucket has slots of nodes, a node in as many as it has blocks of outsiders."""
    small = open_.where(F.col("size") <= FEW).withColumn("bits", F.expr("X'00'"))
    large = open_.where(F.col("size") > FEW).join(nodes.select("node", "bits"), "node").select(small.columns).transform(arrow(_folded, small.schema))
    stray = F.col("comp") != F.col("top")
    rows = small.unionByName(large).select("sig", "node", "n", "late", "comp", "bits", stray.alias("stray"), F.expr(f"cast((size - 1) div {NODES} + 1 as int)").alias("slots"), F.expr(f"cast((outside - 1) div {OUTSIDERS} + 1 as int)").alias("blocks"))
    rows = rows.withColumn("turn", F.xxhash64("node", "sig"))
    of = lambda n: F.pmod("turn", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["sig", "block", "slot", "outsider", "stray", "node", "n", "late", "comp", "bits"]
    out = rows.where("stray").withColumn("block", of("blocks")).withColumn("slot", every("slots")).withColumn("outsider", F.lit(True))
    members = rows.withColumn("slot", of("slots")).withColumn("block", every("blocks")).withColumn("outsider", F.lit(False))
    cells = out.select(columns).unionByName(members.select(columns)).repartition("sig", "block", "slot").sortWithinPartitions("sig", "block", "slot", F.desc("outsider"))
    return cells.transform(arrow(_in_cells(best), _CELL))


_SLOTTED = "comp bigint, i int, j int, side boolean, node bigint, copies bigint, tokens binary"


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set to the cells (i, j), i <= j, in which its slot meets all slots; side: whether it comes as slot j."""
    names = [c.split()[0] for c in _SLOTTED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        comp, slot, slots, node, copies = (batch[c].to_pylist() for c in ("comp", "slot", "slots", "node", "copies"))
        out: list[tuple] = []
        size = 0

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for k, tokens in enumerate(_sets(batch)):
            raw, s = tokens.tobytes(), slot[k]
            for other in range(slots[k]):
                out.append((comp[k], min(s, other), max(s, other), other < s, node[k], copies[k], raw))
                size += len(raw)
                if size > 8_000_000:
                    yield flush(out)
                    out, size = [], 0
        if out:
            yield flush(out)


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of left shares with each of right: products of 0-1 matrices, some columns at a time."""
    sets = [*left, *right]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1  # the others are shared by none
    rank = np.cumsum(several) - 1
    keep = several[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((len(left), len(right)), np.int64)
    for base in range(0, int(several.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (base, base + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, int(column[hi - 1]) - base + 1)), np.float32)
        has[row[lo:hi], column[lo:hi] - base] = 1
        found += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of cells: for each node of a cell how many documents with other sets of the cell link to it. One
    cell is kept at a time."""

    def links(sets: list[np.ndarray], side: list[bool], node: list[int], copies: list[int]) -> Iterator[tuple[int, int]]:
        second = np.array(side, bool)
        at, of = np.flatnonzero(~second), np.flatnonzero(second)
        within = not len(of)
        of = at if within else of
        if not len(at) or (within and len(at) < 2):
            return
        n, times = np.array([len(x) for x in sets]), np.array(copies, np.int64)
        inter = shared_tokens([sets[x] for x in at], [sets[x] for x in of])
        link = THRESHOLD[1] * inter >= THRESHOLD[0] * (n[at][:, None] + n[of][None, :] - inter)
        if within:
            np.fill_diagonal(link, False)
        yield from zip((node[x] for x in at), (link @ times[of]).tolist(), strict=True)
        if not within:
            yield from zip((node[x] for x in of), (times[at] @ link).tolist(), strict=True)

    def whole(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["node", "links"])

    last, held, found = None, ([], [], [], []), []
    for batch in batches:
        comp, i, j, side, node, copies = (batch[c].to_pylist() for c in ("comp", "i", "j", "side", "node", "copies"))
        for k, raw in enumerate(batch["tokens"]):
            if (cell := (comp[k], i[k], j[k])) != last:
                found.extend(links(*held))
                last, held = cell, ([], [], [], [])
            for kept, x in zip(held, (np.frombuffer(raw.as_py(), np.uint64), side[k], node[k], copies[k]), strict=True):
                kept.append(x)
        if found:
            yield whole(found)
            found = []
    found.extend(links(*held))
    if found:
        yield whole(found)


def linked(comp: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, links: how many documents with other sets link to each node of comp (node, comp). nodes: node, row_key, n, copies."""
    own = nodes.select("node", "row_key", "n", "copies").join(comp, "node")
    cut = own.groupBy("comp").agg(F.expr(f"cast(greatest((count(*) - 1) div {SLOT_NODES}, (sum(n) - 1) div {SLOT_TOKENS}) + 1 as int)").alias("slots"))
    wanted = table(own.join(cut, "comp").select("row_key", "node", "comp", "copies", "slots", F.pmod(F.xxhash64("node"), "slots").cast("int").alias("slot")), "slots")
    texts = Member(wanted.select(F.col("row_key").alias("key"))).sift(docs.select("row_key", "text"), "row_key")
    # of repeated rows one text; they have equal keys, so the first to come will do
    one = texts.join(wanted.hint("merge"), "row_key").dropDuplicates(["row_key"])
    cells = one.transform(arrow(_slotted, _SLOTTED)).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return cells.transform(arrow(_counted, "node bigint, links bigint")).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, row_key, n_shingles, node, and group: the node's component (null for an empty set). links: also n_links, the
    number of other documents that each one links with."""
    own, nodes, comp = _grouped(docs)
    n_links = []
    if links:
        several = table(linked(comp, nodes, keyed(docs)), "linked")
        known = nodes.select("node", "copies").join(comp, "node", "left").join(several, "node", "left").where("copies > 1 or comp is not null")
        comp = table(known.select("node", "comp", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
        n_links = [F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")]
    return own.join(comp, "node", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("group"), *n_links)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, row_key, node, n), the nodes (node, row_key, n, bits, copies) and the components (node, comp) of
    nodes that have links to others."""
    bounded_batches(docs.sparkSession)
    docs = keyed(docs)
    read = table(docs.transform(arrow(_read, "kind int, doc_id bigint, row_key bigint, node bigint, n bigint, bits binary")), "sets")
    own = read.where("kind = 0")
    buckets = index(docs, *frequent(read.where("kind = 1")))
    first = table(stars(buckets), "buckets")
    again = stars(first.where("part > 0 and node = centre").select("sig", F.lit(0).alias("part"), "node", "n", "late"))
    again = table(again, "parts")
    pair = lambda df: df.where(_pairs("centre", "node", "cn", "n", "clate", "late")).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    pairs = table(pair(first).unionByName(pair(again)).distinct(), "pairs")
    nodes = table(own.where("n > 0").groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bits", True).alias("bits"), F.count("*").alias("copies")), "nodes")
    links = table(verified(table(plausible(pairs, nodes), "plausible"), nodes.select("node", "row_key"), docs), "links")
    comp = table(components(links), "comps")
    light = nodes.select("node", "row_key")
    # rows that stand too late for any partner that the bucket has, or could have, meet nobody there
    least = first.groupBy("sig").agg(F.min("n").alias("low"), F.count("*").alias("whole"))
    able = "late <= n - " + _common("n", f"greatest(low, ({THRESHOLD[0]} * n + {THRESHOLD[1] - 1}) div {THRESHOLD[1]})")
    members = table(first.join(least, "sig").where(able).select("sig", "node", "n", "late", "whole"), "members")
    met = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fresh = lambda df, *seen: df.join(reduce(DataFrame.unionByName, map(met, seen)), ["a", "b"], "left_anti")
    open_ = unsettled(members, comp)
    likely = crossed(open_, nodes, True).groupBy("a", "other").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
    tried = table(fresh(met(likely), pairs), "tried")
    more = table(verified(table(plausible(tried, nodes), "plausible"), light, docs), "links")
    if not more.isEmpty():
        links = table(links.unionByName(more), "links")
        comp = table(components(links), "comps")
        drop_table(open_)
        open_ = unsettled(members, comp)
    rest = table(plausible(fresh(met(crossed(open_, nodes, False)), pairs, tried), nodes), "rest")
    if not rest.isEmpty():
        more = table(verified(rest, light, docs), "links")
        comp = table(components(links.unionByName(more)), "comps")
    drop_table(first, again, open_)
    return own, nodes, comp


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, less all but one of each component: the one of the smallest id stays, of repeated rows one. Documents with
    empty sets stay. Rows are only compared with the list of those that go or are repeated."""
    found = table(near_duplicates(docs).select("doc_id", "row_key", "group"), "groups")
    # a table of its own: the join below can then be split where a component is large
    best = table(found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("best")), "best")
    rows = table(found.where("group is not null").groupBy("row_key", "group").agg(F.count("*").alias("times")), "rows")
    marks = rows.join(best, "group").select(F.col("row_key").alias("mark"), (F.col("row_key") != F.col("best.row_key")).alias("goes"), "times").where("goes or times > 1")
    marks = table(marks, "marks")
    keyed_ = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), F.xxhash64(*docs.columns).alias("tie"))
    single = keyed_.join(marks, F.col("key") == F.col("mark"), "left_anti").select("row")
    # of rows with equal id and text the whole row decides
    again = keyed_.join(marks.where("not goes"), F.col("key") == F.col("mark")).groupBy("key").agg(F.min_by("row", "tie").alias("row")).select("row")
    return single.unionByName(again).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: the size of its set, the smallest id of its component and the number of its links."""
    found = table(near_duplicates(docs, links=True), "groups")
    least = table(found.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "least")
    return found.join(least, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "n_links")
