"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once over the whole text. The ledger holds the measurements and one integer whose bits say which
rules failed. Policies are versioned sets of rules, applied to the ledger without reading a text again; ablations are bitwise
aggregates over it.

Defined results: a null or empty text has no words and fails `few_words`; null ids, other null columns and repeated rows pass
through row by row; an empty table gives an empty ledger; extra columns of the input are kept out of the ledger unless they
are named in `carry`, and a carried column of a ledger's own name is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, arrow, bounded_batches, chunks, flat, mixed, per_doc, twice, word_spans

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_echo_words")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    failed: str  # SQL over the measurements, in integers


#: Bits are never reused; a new rule takes the next one.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule(5, "no_letters", "100 * n_alpha_words < 40 * n_words"),
    Rule(6, "echoed_words", "100 * n_echo_words > 30 * n_words"),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"), "v2": tuple(r.name for r in RULES)}


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
#: Bytes that make a word one with letters: ASCII letters, or any byte of a longer sequence.
_LETTER = np.zeros(256, np.int8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each document of a flat batch."""
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    hashes = Rolling(data)
    words = mixed(hashes.of(start, end) + (end - start).astype(np.uint64))
    first = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    count = lambda d, w=None: np.bincount(d, w, n).astype(np.int64)
    out = {"n_words": count(doc), "word_chars": count(doc, first[end] - first[start]), "n_symbols": per_doc(_SYMBOL[data], offsets)}
    out["n_alpha_words"] = count(doc, letters[end] > letters[start])
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out["n_echo_words"] = count(doc, echo)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        k = len(words) - WINDOW + 1
        whole = doc[WINDOW - 1 :] == doc[:k]
        key = np.zeros(k, np.uint64)
        for i in range(WINDOW):
            key = mixed(key + words[i : i + k])
        at = np.flatnonzero(whole)
        repeated, _ = twice(doc[at], key[at])
        np.add.at(covered, at[repeated], 1)
        np.subtract.at(covered, at[repeated] + WINDOW, 1)
    out["n_repeat_words"] = count(doc, np.cumsum(covered)[:-1] > 0)
    breaks = np.flatnonzero(data == 0x0A)
    line = np.unique(np.concatenate([offsets[:-1], breaks + 1]))  # where lines start; of empty ones none counts
    line = line[line < len(data)]
    stop = np.append(line[1:], len(data))
    stop -= (data[stop - 1] == 0x0A) & (stop > line)
    owner = np.searchsorted(offsets, line, "right") - 1
    seen = np.searchsorted(start, stop, "left") > np.searchsorted(start, line, "left")
    line, stop, owner = line[seen], stop[seen], owner[seen]
    _, earlier = twice(owner, mixed(hashes.of(line, stop) + (stop - line).astype(np.uint64)))
    out["n_lines"], out["n_dup_lines"] = count(owner), count(owner, earlier)
    return out


def _measured(batches: Iterator[pa.RecordBatch], keep: Sequence[str], inside: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(pc.struct_field(batch[inside], "text") if inside else batch["text"])
        parts = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
        found = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *found], [*keep, *MEASURES])


def ledger(docs: DataFrame, carry: Sequence[str] = ("doc_id",), inside: str | None = None) -> DataFrame:
    """One row per document: the carried columns, the measurements, and `failed`, whose bit i is set if rule i failed. inside: a
    carried struct that has the text; without it there is a column of that name."""
    if clash := {*carry} & {*MEASURES, "failed"}:
        raise ValueError(f"columns of the ledger's own names: {sorted(clash)}")
    bounded_batches(docs.sparkSession)
    keep = list(carry)
    own = docs.select(*keep, *(["text"] if "text" not in keep and not inside else []))
    schema = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep), *(f"{m} bigint" for m in MEASURES)])
    rows = own.transform(arrow(lambda it: _measured(it, keep, inside), schema))
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits + F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("failed", bits)


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents it fails, how many it alone rejects (they would stay without it), and
    how many stay under the whole policy. One pass; a partial sum per rule, whatever the number of documents."""
    used = [r for r in RULES if r.name in POLICIES[policy]]
    hit = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(f"{k}{r.bit}") for r in used for k, c in (("f", hit.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0), ("o", hit == (1 << r.bit)))]
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(hit == 0, 1).otherwise(0)), F.lit(0)).alias("kept"), *sums)
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.coalesce(f"f{r.bit}", F.lit(0)).alias("n_failed"), F.coalesce(f"o{r.bit}", F.lit(0)).alias("n_only")) for r in used))
    return total.select(F.explode(each).alias("x"), "n", "kept").select("x.*", F.col("n").alias("n_docs"), F.col("kept").alias("n_kept"))


def digest(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The query's columns: base measurements, the base verdict and the policy's."""
    base = ~passes("base")
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), F.col("failed").alias("failed_rules"))


def kept(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that pass, with all their own columns; the rows travel as one struct, so no name can clash."""
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    return ledger(whole, ("row",), inside="row").where(passes("base") & passes(policy)).select("row.*")
