"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are sequences of words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, so marks and
white space don't count. An item of m words may differ from a passage by k = floor(0.15 m) word edits (k smaller where pieces
would get shorter than MIN_PIECE words). Cut into k + 1 pieces, at least one piece of a passage within the budget is unchanged,
so every exact hit of a piece, and only these, is verified with Myers' bit-parallel edit distance around the place where the
item would lie. No passage within the budget is missed.

The corpus is scanned once for each block of ITEMS items, without a shuffle; a block's pieces are all that is broadcast.

Defined results: a null or empty text has no matches; items with fewer than MIN_ITEM words or a null text name no passage;
null ids are carried as null; repeated rows each get their matches; an empty table on either side gives no rows; extra columns
are ignored. Matches of an item that overlap in a text are one row, the closest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, arrow, bounded_batches, chunks, flat, mixed, table, word_spans

RATE, MIN_PIECE, MIN_ITEM = 0.15, 4, 5
#: Items of one block.
ITEMS = 50_000

OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a flat, lower-cased batch, and their documents."""
    start, end, doc = word_spans(data, offsets, OUTSIDE)
    return mixed(Rolling(data).of(start, end) + (end - start).astype(np.uint64)), doc


def budget(m: int) -> int:
    return max(0, min(int(RATE * m), m // MIN_PIECE - 1))


def cuts(m: int) -> list[tuple[int, int]]:
    k = budget(m)
    return [(m * i // (k + 1), m * (i + 1) // (k + 1)) for i in range(k + 1)]


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """For each end in text, the least edit distance of the pattern to a substring that ends there."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, d, out = full, 0, m, []
    for w in text:
        eq = where.get(w, 0)
        x = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        d += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        out.append(d)
    return out


def closest(pattern: list[int], text: list[int]) -> tuple[int, int, int] | None:
    """(distance, first, end) of the closest match within the budget, or None; of equals the first to end, and the longest."""
    ends = myers(pattern, text)
    if not ends or (d := min(ends)) > budget(len(pattern)):
        return None
    end = ends.index(d) + 1
    back = myers(pattern[::-1], text[:end][::-1][: len(pattern) + d])
    n = max(i + 1 for i, x in enumerate(back) if x == d and _whole(pattern, text[end - i - 1 : end]) == d)
    return d, end - n, end


def _whole(a: list[int], b: list[int]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Pieces:
    """The pieces of a block of items, by length: sorted hashes, and the item and offset of each."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, self.items = [i for i, _ in items], []
        by: dict[int, list[tuple[int, int, int]]] = {}
        data, offsets = flat(pa.array([t for _, t in items], pa.string()), lower=True)
        hashes, doc = words(data, offsets)
        first = np.searchsorted(doc, np.arange(len(items) + 1))
        for n in range(len(items)):
            own = hashes[first[n] : first[n + 1]]
            self.items.append(own.tolist())
            for lo, hi in cuts(len(own)) if len(own) >= MIN_ITEM else []:
                by.setdefault(hi - lo, []).append((int(_windows(own[lo:hi], hi - lo)[0]), n, lo))
        self.by = {}
        for length, found in sorted(by.items()):
            found.sort()
            key = np.array([x[0] for x in found], np.uint64)
            hint = np.zeros(1 << 20, bool)
            hint[key & np.uint64(len(hint) - 1)] = True
            self.by[length] = (key, np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64), hint)

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, where the item would begin, in words of the batch) of every exact piece."""
        out: list[tuple[np.ndarray, ...]] = []
        for length, (key, item, offset, hint) in self.by.items():
            windows = _windows(hashes, length)
            at = np.flatnonzero(hint[windows & np.uint64(len(hint) - 1)])
            at = at[doc[at + length - 1] == doc[at]] if len(at) else at
            lo, hi = np.searchsorted(key, windows[at], "left"), np.searchsorted(key, windows[at], "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            out.append((doc[at], item[which], at - offset[which]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def _windows(hashes: np.ndarray, length: int) -> np.ndarray:
    n = max(len(hashes) - length + 1, 0)
    key = np.zeros(n, np.uint64)
    for i in range(length):
        key = mixed(key + hashes[i : i + n])
    return key


def found(pieces: Pieces, hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, first word, words, edits) of each match."""
    d, item, begin = pieces.hits(hashes, doc)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    order = np.lexsort((begin, item, d))
    spans: list[list[int]] = []
    for i in order.tolist():
        m = len(pieces.items[item[i]])
        k = budget(m)
        lo, hi = max(int(begin[i]) - k, int(first[d[i]])), min(int(begin[i]) + m + k, int(first[d[i] + 1]))
        if spans and spans[-1][:2] == [d[i], item[i]] and lo <= spans[-1][3]:
            spans[-1][3] = max(hi, spans[-1][3])
        else:
            spans.append([int(d[i]), int(item[i]), lo, hi])
    for n, which, lo, hi in spans:
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if got := closest(pieces.items[which], hashes[lo:hi].tolist()):
                edits, a, b = got
                yield n, which, lo + a - int(first[n]), b - a, edits
                todo += [(lo, lo + a), (lo + b, hi)]  # the same item may come again in what is left


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits: every passage that is an item within its budget."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = max(1, -(-benchmark.count() // ITEMS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (_block(rows, benchmark.where(own == b).select(F.col("item_id").cast("long"), "text").collect()) for b in range(blocks)))


def _block(rows: DataFrame, items: list) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items])
    kept: dict[str, Pieces] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept.setdefault("pieces", Pieces(shared.value))
        for batch in batches:
            data, offsets = flat(batch["text"], lower=True)
            got: list[tuple] = []
            for i, j in chunks(offsets):
                hashes, doc = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                got += [(i + d, pieces.ids[n], a, m, e) for d, n, a, m, e in found(pieces, hashes, doc, j - i)]
            if got:
                at, item, first, n, edits = (pa.array(c, pa.int64()) for c in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), item, first, n, edits], ["doc_id", "item_id", "first_word", "n_words", "edits"])

    return rows.transform(arrow(run, "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, edits bigint"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match, with all their own columns. Rows are told apart by id and text; what is joined is the
    list of rows that match, which is made first."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"), key.alias("doc_id"))
    bad = table(matches(keyed.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("bad")).distinct(), "matched")
    return keyed.join(bad, F.col("doc_id") == F.col("bad"), "left_anti").select("row.*")
