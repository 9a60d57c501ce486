"""Repeated passages by prefix-free parsing: every byte that a LENGTH-byte string covers which also starts anywhere else.

Texts are parsed at triggers: places where a rolling hash of WINDOW bytes falls below a threshold, about every EVERY bytes. A
trigger depends on its own bytes only, so equal passages are parsed alike wherever they stand. A suffix of the corpus then is
the rest of a dictionary phrase up to its trigger, followed by the parse from there, and suffixes are put into corpus order by
the pair (phrase suffix, parse suffix). As only the first LENGTH bytes matter, both orders are cut at that depth: suffixes that
agree so far get one rank (a 64-bit hash of the bytes), and equal ranks stand side by side in the sorted corpus. So the order
is that of ranks, not of the alphabet, which decides the same repeats.

1. For a string whose first trigger is at most REACH bytes from its start, the bytes from the trigger on that every such string
   has (the core) are the parse rank to sort by first. Second comes the rank of the whole context: from the earliest to the
   latest string that has this first trigger. Equal contexts make all strings of the trigger repeated at once.
2. Where a core is met with different contexts, the strings of these triggers are ranked in blocks of BLOCK neighbours, each with
   a core and a context of its own, and sorted again; where a block's core is met with different contexts, string by string.
3. Strings without a trigger that early are ranked one by one in the first sort.

Passages of PASSAGE words that another document has too are found beside that, in the same sorts: a parse of the words, whose
triggers are the smallest of the hashes of CORE_WORDS words from each place that a passage has, so that every passage has exactly
one and equal passages have the same. They are reported, not removed, as many are shorter than LENGTH bytes.

Each batch sorts its own suffixes first and sends one of each rank, so a passage with any number of copies is a few rows of the
shuffle. Texts are read again for each level, and shuffled only where documents have repeats.

Defined results: a null or empty text has no bytes and nothing removed (checksum of nothing); texts shorter than LENGTH lose
nothing; a repeated row is a copy, so both lose what is long enough; null ids are carried; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, arrow, bounded_batches, chunks, flat, mixed, per_doc, table, word_spans
from .components import Member

LENGTH, WINDOW, EVERY, REACH, BLOCK = 400, 12, 40, 272, 8
#: Words of a passage, and of the part of it that it is looked up by.
PASSAGE, CORE_WORDS = 51, 25
_LIMIT = np.uint64((1 << 64) // EVERY)
_WORD, _CORE, _CONTEXT, _SINGLE, _LEN, _AT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


class Parse:
    """The triggers of a flat batch, and the strings that have none nearby. lo and hi: the distances from the start of a string
    to its first trigger, at a trigger; strings with lo > hi do not exist."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.hashes = Rolling(data)
        n = len(data)
        places = np.arange(max(n - WINDOW + 1, 0))
        h = mixed(self.hashes.of(places, places + WINDOW)) if len(places) else np.zeros(0, np.uint64)
        q = np.flatnonzero(h < _LIMIT)
        doc = np.searchsorted(offsets, q, "right") - 1
        inside = q + WINDOW <= offsets[doc + 1]
        q, doc = q[inside], doc[inside]
        first, end = offsets[doc], offsets[doc + 1]
        before = np.full(len(q), -1, np.int64)
        before[1:] = q[:-1]
        hi = np.minimum(np.minimum(REACH, q - np.maximum(before, first - 1) - 1), q - first)
        lo = np.maximum(0, q + LENGTH - end)
        ok = lo <= hi
        self.q, self.doc, self.lo, self.hi = q[ok], doc[ok], lo[ok], hi[ok]
        # strings whose next trigger is further than REACH
        gaps = []
        for d in np.flatnonzero(np.diff(offsets) >= LENGTH):
            a, b = np.searchsorted(q, (offsets[d], offsets[d + 1]))
            stop = offsets[d + 1] - LENGTH + 1  # after the last string
            marks = np.concatenate([[offsets[d] - 1], q[a:b]])
            ends = np.append(q[a:b] - REACH, stop)
            for s, e in zip(marks + 1, np.minimum(ends, stop), strict=True):
                if s < e:
                    gaps.append(np.arange(s, e))
        self.single = np.concatenate(gaps) if gaps else np.zeros(0, np.int64)
        self.single_doc = np.searchsorted(offsets, self.single, "right") - 1

    def core(self) -> np.ndarray:
        return mixed(self.hashes.of(self.q, self.q + LENGTH - REACH) ^ _CORE)

    def context(self, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The rank of the strings that start lo to hi bytes before q, together."""
        start, end = q - hi, q + LENGTH - lo
        return mixed(mixed(self.hashes.of(start, end) ^ _CONTEXT) + (end - start).astype(np.uint64) * _LEN + hi.astype(np.uint64) * _AT)

    def blocks(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """For triggers: trigger, lo, hi and core of each block of BLOCK neighbouring starts. Blocks lie at fixed distances from
        the trigger; a core is what all strings of a full block have."""
        first, last = self.lo[at] // BLOCK, self.hi[at] // BLOCK
        n = last - first + 1
        t = np.repeat(at, n)
        k = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        lo, hi = np.maximum(self.lo[t], k * BLOCK), np.minimum(self.hi[t], k * BLOCK + BLOCK - 1)
        start, end = self.q[t] - k * BLOCK, self.q[t] + LENGTH - (k * BLOCK + BLOCK - 1)
        return t, lo, hi, mixed(mixed(self.hashes.of(start, end) ^ _CORE) + (k + 1).astype(np.uint64) * _AT)

    def strings(self, start: np.ndarray) -> np.ndarray:
        return mixed(self.hashes.of(start, start + LENGTH) ^ _SINGLE)


class Passages:
    """The triggers of the words of a batch: doc, at (the word where the core begins), and lo and hi, the first and the last
    start of a passage of this trigger. Words are numbered over the batch; base: the first of each document."""

    def __init__(self, hashes: Rolling, data: np.ndarray, offsets: np.ndarray):
        start, end, doc = word_spans(data, offsets)
        words = mixed(hashes.of(start, end) + (end - start).astype(np.uint64) * _LEN)
        self.hashes = Rolling(values=words)
        self.base = np.searchsorted(doc, np.arange(len(offsets) - 1))
        n = len(words) - PASSAGE + 1
        if n <= 0:
            self.doc = self.at = self.lo = self.hi = np.zeros(0, np.int64)
            return
        i = np.arange(len(words) - CORE_WORDS + 1)
        cores = mixed(self.hashes.of(i, i + CORE_WORDS) ^ _WORD)
        at = np.arange(n) + sliding_window_view(cores, PASSAGE - CORE_WORDS + 1)[:n].argmin(axis=1)
        starts = np.flatnonzero(doc[:n] == doc[PASSAGE - 1 :])  # passages that end in their document
        if not len(starts):
            self.doc = self.at = self.lo = self.hi = np.zeros(0, np.int64)
            return
        head = np.ones(len(starts), bool)
        head[1:] = (at[starts[1:]] != at[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])
        self.lo = starts[head]
        self.hi = starts[np.append(np.flatnonzero(head)[1:], len(starts)) - 1]
        self.at, self.doc = at[self.lo], doc[self.lo]

    def core(self) -> np.ndarray:
        return mixed(self.hashes.of(self.at, self.at + CORE_WORDS) ^ _WORD)

    def context(self) -> np.ndarray:
        """The rank of all passages of a trigger together."""
        end = self.hi + PASSAGE
        return mixed(mixed(self.hashes.of(self.lo, end) ^ _WORD) + (end - self.lo).astype(np.uint64) * _LEN + (self.at - self.lo).astype(np.uint64) * _AT)

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, document and start of each passage of these triggers."""
        n = self.hi[at] - self.lo[at] + 1
        start = np.repeat(self.lo[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return mixed(self.hashes.of(start, start + PASSAGE) ^ _SINGLE ^ _WORD), np.repeat(self.doc[at], n), start


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, Parse]]:
    data, offsets = flat(batch["text"])
    for i, j in chunks(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, own, at, Parse(own, at)


#: place: first and last in 32 bits each, as these rows are sorted by the million and every column of a row takes 8 bytes.
_ROWS = "core bigint, context bigint, doc bigint, place bigint, kind tinyint"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_SPAN, _KNOWN, _WORDS = 1, 2, 4


def _table(core: np.ndarray, context: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, span: bool, known: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """Rows for the strings that start from first to last in a document. span: they are repeated, core and context say nothing;
    else they are ranked by (core, context), and known says that their spans have been given. words: they are passages, and
    first and last count words."""
    place = first.astype(np.int64) << 32 | last.astype(np.int64)
    kind = span * _SPAN + known * _KNOWN + words * _WORDS
    return pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(place), pa.array(kind.astype(np.int8))], _NAMES)


def _spans(doc: np.ndarray, first: np.ndarray, last: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    return _table(mixed(doc.view(np.uint64)), np.zeros(len(doc), np.uint64), doc, first, last, True, np.ones(len(doc), bool), words)


def _ranked(core: np.ndarray, context: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray, words: bool) -> Iterator[pa.RecordBatch]:
    """One row of each (core, context) of a batch, and the repeats inside the batch as few spans. doc: rows of the batch. Of equal
    passages of one document only the first counts, so that repeats are those of several documents."""
    if words:
        order = np.lexsort((first, doc, context, core))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (core[order][1:] != core[order][:-1]) | (context[order][1:] != context[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        core, context, doc, first, last = (x[order[fresh]] for x in (core, context, doc, first, last))
    order = np.lexsort((context, core))
    same = np.zeros(len(order), bool)
    same[1:] = (core[order][1:] == core[order][:-1]) & (context[order][1:] == context[order][:-1])
    again = same.copy()
    again[:-1] |= same[1:]
    one = order[~same]
    yield _table(core[one], context[one], keys[doc[one]], first[one], last[one], False, again[~same], np.full(len(one), words))
    many = order[again]
    if len(many):
        many = many[np.lexsort((first[many], doc[many]))]
        d, a, b = doc[many], first[many], last[many]
        reach = np.maximum.accumulate(b + d * (1 << 40)) - d * (1 << 40)
        begin = np.ones(len(d), bool)
        # every string covers LENGTH bytes, so starts up to that far apart leave no byte between them
        begin[1:] = (d[1:] != d[:-1]) | (a[1:] > reach[:-1] + (PASSAGE if words else LENGTH))
        at = np.flatnonzero(begin)
        yield _spans(keys[d[at]], a[at], np.maximum.reduceat(b, at), np.full(len(at), words))


Known = Callable[[np.ndarray], np.ndarray]


def _level(batches: Iterator[pa.RecordBatch], several: list[Known]) -> Iterator[pa.RecordBatch]:
    """Ranks the strings of a level: without filters whole triggers and single strings, with one the blocks of triggers whose
    core may have several contexts (and, one by one, the passages of such triggers), with two the strings of blocks of which
    the same holds."""
    for batch in batches:
        keys = batch["row_key"].to_numpy()
        parts: list[tuple[np.ndarray, ...]] = []
        found: list[tuple[np.ndarray, ...]] = []
        for i, data, offsets, p in _parsed(batch):
            if len(several) < 2:
                w = Passages(p.hashes, data, offsets)
                if several:
                    rank, doc, at = w.strings(np.flatnonzero(several[0](w.core().view(np.int64))))
                    found.append((rank, rank, i + doc, at - w.base[doc], at - w.base[doc]))
                else:
                    found.append((w.core(), w.context(), i + w.doc, w.lo - w.base[w.doc], w.hi - w.base[w.doc]))
            if not several:
                base = offsets[p.doc]
                parts.append((p.core(), p.context(p.lo, p.hi, p.q), i + p.doc, p.q - p.hi - base, p.q - p.lo - base))
                s = p.strings(p.single)
                at = p.single - offsets[p.single_doc]
                parts.append((s, s, i + p.single_doc, at, at))
                continue
            t, lo, hi, core = p.blocks(np.flatnonzero(several[0](p.core().view(np.int64))))
            context = p.context(lo, hi, p.q[t])
            if len(several) > 1:
                _, fresh = np.unique(context, return_index=True)  # equal contexts have equal strings: one of them will do
                ok = fresh[several[1](core[fresh].view(np.int64))]
                n = hi[ok] - lo[ok] + 1
                start = np.repeat(p.q[t[ok]] - hi[ok], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                doc, core = np.repeat(p.doc[t[ok]], n), p.strings(start)
                parts.append((core, core, i + doc, start - offsets[doc], start - offsets[doc]))
            else:
                doc = p.doc[t]
                parts.append((core, context, i + doc, p.q[t] - hi - offsets[doc], p.q[t] - lo - offsets[doc]))
        for rows, words in ((parts, False), (found, True)):
            if rows:
                yield from _ranked(*(np.concatenate(x) for x in zip(*rows, strict=True)), keys, words)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of (core, context): spans of repeated strings, and rows that name a core met with several
    contexts. Of a run across batches only the row before is kept."""
    last: dict | None = None
    for whole in batches:
        passing = whole["kind"].to_numpy() & _SPAN > 0
        if passing.any():
            yield whole.filter(pa.array(passing))
        b = whole.filter(pa.array(~passing))
        if not b.num_rows:
            continue
        core, context = b["core"].to_numpy().view(np.uint64), b["context"].to_numpy().view(np.uint64)
        doc, place, kind = (b[c].to_numpy() for c in ("doc", "place", "kind"))
        first, end, known, words = place >> 32, place & 0xFFFFFFFF, kind & _KNOWN > 0, kind & _WORDS > 0
        n = len(core)
        equal_core, equal = np.zeros(n, bool), np.zeros(n, bool)
        equal_core[1:] = core[1:] == core[:-1]
        equal[1:] = equal_core[1:] & (context[1:] == context[:-1])
        if last is not None and core[0] == last["core"]:
            equal_core[0] = True
            equal[0] = context[0] == last["context"]
        repeated = equal.copy()
        repeated[:-1] |= equal[1:]
        if equal[0] and not last["given"]:
            yield _spans(*(np.array([last[k]]) for k in ("doc", "first", "end", "words")))
        at = np.flatnonzero(repeated & ~known)
        if len(at):
            yield _spans(doc[at], first[at], end[at], words[at])
        several = np.unique(core[equal_core & ~equal])
        if len(several):
            z = np.zeros(len(several), np.int64)
            yield _table(several, np.zeros(len(several), np.uint64), z, z, z, False, np.ones(len(several), bool), z > 0)
        last = {"core": core[-1], "context": context[-1], "doc": doc[-1], "first": first[-1], "end": end[-1], "words": words[-1], "given": bool(repeated[-1] or known[-1])}


def starts(docs: DataFrame) -> DataFrame:
    """doc (row_key), first, last, words: spans of starts of strings that also start elsewhere, and, where words says so, of
    starts (counted in words) of passages that other documents have, of documents (row_key, text)."""
    several: list[Known] = []
    found = []
    for _ in range(3):
        have = list(several)
        ranked = docs.select("row_key", "text").transform(arrow(lambda it, have=have: _level(it, have), _ROWS))
        ordered = ranked.repartition("core").sortWithinPartitions("core", "context").transform(arrow(_sorted_runs, _ROWS))
        ordered = table(ordered, "ordered")
        span = F.col("kind").bitwiseAND(_SPAN) > 0
        first, last = F.shiftright("place", 32), F.col("place").bitwiseAND(0xFFFFFFFF)
        found.append(ordered.where(span).select("doc", first.cast("int").alias("first"), last.cast("int").alias("last"), (F.col("kind").bitwiseAND(_WORDS) > 0).alias("words")))
        several.append(Member(ordered.where(~span).select(F.col("core").alias("key")).distinct()).test())
    return reduce(DataFrame.unionByName, found)


def _listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of all spans of a column of lists."""
    row, spans = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    return row, *(spans.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their spans; texts: with these bytes."""
    for batch in batches:
        data, offsets = flat(batch["text"])
        size = np.diff(offsets)
        row, first, last = _listed(batch["found"])
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, offsets[row] + first, 1)
        np.subtract.at(cover, offsets[row] + last + LENGTH, 1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        edges = gone.copy()
        edges[1:] &= ~gone[:-1]
        heads = offsets[:-1][size > 0]
        edges[heads] = gone[heads]
        less = per_doc(gone, offsets)
        left, at = data[~gone], np.concatenate([[0], np.cumsum(size - less)])
        view = memoryview(left)
        sums = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        row, first, last = _listed(batch["said"])
        order = np.lexsort((first, row))
        own = row[order].astype(np.int64) << 40
        begin = np.ones(len(order), bool)
        begin[1:] = (own + first[order])[1:] > np.maximum.accumulate(own + last[order] + PASSAGE)[:-1]
        passages = np.bincount(row[order][begin], minlength=len(size))
        columns = [batch["doc_id"], pa.array(size), pa.array(less), pa.array(per_doc(edges, offsets)), pa.array(sums, pa.string()), pa.array(passages.astype(np.int64))]
        if texts:
            columns.append(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(left)]).cast(pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in (_DIGEST + _KEPT if texts else _DIGEST).split(", ")])


_DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint"
_KEPT = ", kept binary"


def removed(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages (runs of words made of passages of PASSAGE words that other
    documents have too, whatever their bytes) of every document and, with texts, kept (the bytes that stay)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    spans = starts(rows)
    # at most as many spans as the document has strings
    found = table(spans.groupBy("doc").agg(*(F.collect_set(F.when(kind, F.struct("first", "last"))).alias(c) for c, kind in (("found", ~F.col("words")), ("said", F.col("words"))))), "spans")
    # only documents that may have spans are shuffled to them
    touched = Member(found.select(F.col("doc").alias("key"))).test()
    may = lambda wanted: rows.transform(arrow(lambda it: (b.filter(pa.array(touched(b["row_key"].to_numpy()) == wanted)) for b in it), rows.schema))
    met = may(True).join(found.hint("merge"), F.col("row_key") == F.col("doc"), "left").select("doc_id", "text", "found", "said")
    rest = may(False).select("doc_id", "text", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("found", "said")))
    return met.unionByName(rest).transform(arrow(lambda it: _cut(it, texts), _DIGEST + _KEPT if texts else _DIGEST))


def digest(docs: DataFrame) -> DataFrame:
    return removed(docs, texts=False)
