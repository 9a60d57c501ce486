"""Token ids in files of a grammar-compressed format (Re-Pair), with random access.

Documents in ascending id order are encoded, an end id follows each, and runs of about SHARD_TOKENS ids become shards. In each
shard, frequent pairs of neighbouring symbols are replaced by new symbols (nonterminals), again and again until no pair is
frequent. A file holds the rules, how many ids each rule expands to, the remaining sequence, and the offsets of the ids at
every STEP-th symbol, so a range of ids is decoded from the symbols that cover it.

Layout, little-endian: 8 bytes magic; int64 header (documents, ids, rules, symbols, bytes of a symbol, first nonterminal);
int64 document ids; uint8 whether an id is null; int64 ids of each document; rules as pairs of uint32; uint32 expansion
lengths; int64 offsets; symbols as uint16 or uint32.

Encoding goes by distinct words: this tokenizer drops white space and never joins across it, so the ids of a text are those of
its words in a row (a test compares with whole texts). Each distinct word of a batch is encoded once by the library, and a
worker keeps a bounded number of them.

Defined results: a null or empty text has the end id only; null ids come first; repeated rows are encoded each; documents of
any length are whole within one shard; an empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, arrow, bounded_batches, chunks, flat, new_folder, table

END_ID = 1
SHARD_TOKENS, STEP = 1 << 20, 4096
#: A pair is frequent if it makes up this share of the shard's ids, and at least FEWEST of them.
SHARE, FEWEST = 1 / 8192, 32
#: Rounds end when one shortens the sequence by less than this part, though some pairs may still be frequent.
LEAST_GAIN = 0.02
#: What a vocabulary file must say for texts to be cut at white space and marks before it encodes them; with other settings texts
#: are encoded whole. (Fixed values of the file format.)
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Words that a worker keeps, and how many words one call encodes.
MOST_WORDS, JOINED = 800_000, 128
#: Bytes that one call encodes: the more, the fewer words are looked up again.
PIECE_BYTES = 8_000_000
MAGIC = b"RePair01"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Second bytes of the letters U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


class Encoder:
    """Ids of texts by distinct words. The ids of all known words lie in one pool."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        split = (said["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.cut = said["normalizer"] == NORMALIZER and split[0] == PIECES and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in split[1:])
        self.cut = self.cut and said["model"]["type"] == "BPE" and said["model"].get("end_of_word_suffix") == "</w>" and self.tokenizer.get_vocab_size() < 1 << 16
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that end a piece
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 1
        self.pool[0] = END_ID
        self.at, self.size = np.zeros(1 << 18, np.int32), np.ones(1 << 18, np.int32)  # word 0 is the end of a document

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n, k = len(self.words) + 1, len(words)
        while n + k > len(self.at):
            self.at, self.size = (np.concatenate([x, x]) for x in (self.at, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[n : n + k], self.size[n : n + k] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.words.update(zip(words, range(n, n + k), strict=True))

    def learn(self, words: list[bytes]) -> None:
        """Words of letters only are one piece each, so many go into one call and are cut where pieces end."""
        texts = [w.decode().strip(" \t\n\v\f\r") for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        odd = [i for i, t in enumerate(texts) if not t.isalpha()]
        for lo in range(0, len(plain), JOINED * 64):
            runs = [plain[i : i + JOINED] for i in range(lo, min(lo + JOINED * 64, len(plain)), JOINED)]
            for run, ids in zip(runs, self.whole([" ".join(texts[i] for i in run) for run in runs]), strict=True):
                row = np.array(ids, np.uint16)
                cut = np.flatnonzero(self.ends[row]) + 1
                if len(cut) == len(run) and cut[-1] == len(row):
                    self._add([words[i] for i in run], row, np.diff(cut, prepend=0))
                else:  # a letter that the tokenizer takes apart
                    odd += run
        for lo in range(0, len(odd), 4096):
            part = odd[lo : lo + 4096]
            ids = self.whole([texts[i] for i in part])
            self._add([words[i] for i in part], np.array([x for row in ids for x in row], np.uint16), np.array([*map(len, ids)], np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a flat batch, an end id after each document, and how many each document has. A word is kept with the
        white space behind it, so words lie side by side and none is copied. The tokenizer lower-cases, and a mark behind a
        letter begins a piece; doing both here lets more words be shared. (Batches that may hold
        names of special tokens keep their case, and their names whole.)"""
        n = len(offsets) - 1
        if not self.cut:
            raw = np.ascontiguousarray(data).tobytes()
            rows = [[*ids, END_ID] for ids in self.whole([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])]
            return np.array([x for row in rows for x in row], np.uint32), np.array([*map(len, rows)], np.int64)
        names = b"<|" in memoryview(np.ascontiguousarray(data)).tobytes()
        data = data if names else LOWER[data]
        inside = ~IS_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        mark = np.flatnonzero((data == 0x2C) | (data == 0x2E) if names else _MARK[data])
        mark = mark[mark > 1]
        begins[mark[_LETTER[data[mark - 1]] | ((data[mark - 2] == 0xC3) & _LATIN[data[mark - 1]])]] = True
        edge = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[edge] = inside[edge]
        start = np.flatnonzero(begins)
        if len(self.words) > MOST_WORDS:
            self.forget()
        which = np.zeros(0, np.int32)
        if len(start):
            spans = np.append(start, len(data)).astype(np.int32)
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(spans), pa.py_buffer(data)]).dictionary_encode()
            words = coded.dictionary.to_pylist()
            if new := [w for w in words if w not in self.words]:
                self.learn(new)
            which = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))[coded.indices.to_numpy()]
        last = np.searchsorted(start, offsets[1:])  # the end goes behind the last word of each document
        which = np.insert(which, last, 0)
        count = self.size[which]
        upto = np.cumsum(count, dtype=np.int32)
        index = np.repeat(self.at[which] - (upto - count), count)
        index += np.arange(len(index), dtype=np.int32)
        ends = upto[last + np.arange(n)]
        return self.pool[index], np.diff(ends, prepend=0).astype(np.int64)


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule r replaces a pair of symbols by symbol first + r. Each round counts all pairs and replaces every
    frequent one; of overlapping places every other one, from the left."""
    least = max(FEWEST, int(len(ids) * SHARE))
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.int64)
    while len(seq) > 2 * least:
        bucket = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(14)
        full = np.bincount(bucket, minlength=1 << 18) >= least
        maybe = np.flatnonzero(full[bucket])
        code = seq[maybe].astype(np.int64) << 32 | seq[maybe + 1]
        pair, count = np.unique(code, return_counts=True)
        pair = pair[count >= least]
        if not len(pair):
            break
        found = np.minimum(np.searchsorted(pair, code), len(pair) - 1)
        hit = pair[found] == code
        at, rule = maybe[hit], found[hit]
        new_run = np.ones(len(at), bool)
        new_run[1:] = at[1:] != at[:-1] + 1
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        every_other = (np.arange(len(at)) - begin) % 2 == 0
        at, rule = at[every_other], rule[every_other]
        used, rule = np.unique(rule, return_inverse=True)
        seq[at] = first + len(rules) + rule
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        before, seq = len(seq), seq[keep]
        rules = np.concatenate([rules, np.stack([pair[used] >> 32, pair[used] & 0xFFFFFFFF], 1)])
        if before - len(seq) < LEAST_GAIN * before:
            break
    return rules, seq.astype(np.int64)


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule expands to; a rule only uses earlier ones."""
    out = np.ones(len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids of symbols. Each rule is expanded once; a pool holds all ids, each for itself, and behind them the rules' ids."""
    pool: list[np.ndarray] = []
    for a, b in rules.tolist():
        pool.append(np.concatenate([pool[x - first] if x >= first else np.array([x], np.uint32) for x in (a, b)]))
    ids = np.concatenate([np.arange(first, dtype=np.uint32), *pool])
    size = np.concatenate([np.ones(first, np.int32), lengths.astype(np.int32)])
    place = np.concatenate([np.arange(first, dtype=np.int64), first + np.cumsum(lengths) - lengths])
    count = size[symbols]
    at = np.cumsum(count, dtype=np.int64) - count
    index = np.repeat(place[symbols] - at, count)
    index += np.arange(len(index))
    return ids[index]


def pack(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, first: int) -> bytes:
    rules, symbols = compress(ids, first)
    lengths = expansions(rules, first)
    each = np.ones(len(symbols), np.int64)
    big = symbols >= first
    each[big] = lengths[symbols[big] - first]
    offsets = (np.cumsum(each) - each)[::STEP]
    wide = np.dtype("<u2" if first + len(rules) <= 1 << 16 else "<u4")
    head = np.array([len(doc_ids), len(ids), len(rules), len(symbols), wide.itemsize, first], "<i8")
    return b"".join((MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), null.astype("u1").tobytes(), counts.astype("<i8").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), offsets.astype("<i8").tobytes(), symbols.astype(wide).tobytes()))


class Shard:
    """A file's content, opened."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, n_rules, n_symbols, wide, self.first = (int(x) for x in np.frombuffer(raw, "<i8", 6, 8))
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.counts = take("<i8", self.n_docs), take("u1", self.n_docs).astype(bool), take("<i8", self.n_docs)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.offsets = take("<i8", -(-n_symbols // STEP))
        self.symbols = take(f"<u{wide}", n_symbols)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi-1, from the symbols around them only."""
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.offsets, lo, "right")) - 1
        b = int(np.searchsorted(self.offsets, hi, "left"))
        got = expand(self.symbols[a * STEP : b * STEP], self.rules, self.lengths, self.first)
        return got[lo - int(self.offsets[a]) : hi - int(self.offsets[a])]

    def document(self, i: int) -> np.ndarray:
        start = int(self.counts[:i].sum())
        return self.ids(start, start + int(self.counts[i]))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _written(folder: str, tokenizer: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        first = encoder.tokenizer.get_vocab_size()
        store, root = _store(folder)
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        many = 0

        def put() -> pa.RecordBatch:
            nonlocal k, held, many
            doc_ids, null, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{root}/part-{part:06d}-{k:06d}.rp"
            # a retried or doubled task writes the same content; the move makes it appear whole
            with store.open_output_stream(half := f"{root}/_{uuid.uuid4().hex}") as f:
                f.write(pack(doc_ids, null, counts, ids, first))
            store.move(half, path)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "name": [path.rpartition("/")[2]], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})
            k, held, many = k + 1, [], 0
            return row

        store.create_dir(root, recursive=True)
        for b in batches:
            data, offsets = flat(b["text"])
            own = b["doc_id"]
            doc_ids, null = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets, PIECE_BYTES):
                ids, counts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((doc_ids[i:j], null[i:j], counts, ids))
                many += len(ids)
                if many >= shard_tokens:
                    yield put()
        if held:
            yield put()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the files and returns their list: part, k, name, n_docs, n_ids; (part, k) is the order of the documents."""
    bounded_batches(docs.sparkSession, 2 * PIECE_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = table(ordered.transform(arrow(_written(folder, tokenizer, shard_tokens), "part int, k int, name string, n_docs bigint, n_ids bigint")), "files")
    bounded_batches(docs.sparkSession)
    return files


def placed(files: DataFrame) -> DataFrame:
    """The list with `start`, the ids of all files before: sums by part, then inside each part."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("k")) - F.col("n_ids")
    return files.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def _digests(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for name, start in zip(b["name"].to_pylist(), b["start"].to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                upto = np.cumsum(shard.counts)
                raw = memoryview(np.ascontiguousarray(shard.ids(), "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(upto.tolist(), shard.counts.tolist(), strict=True)]
                ids = pa.array(shard.doc_ids, mask=shard.null)
                yield pa.RecordBatch.from_arrays([ids, pa.array(start + upto - shard.counts), pa.array(shard.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes all documents, reads the files back, and gives each document's place, count and checksum from them."""
    files = write(docs, folder := new_folder(docs.sparkSession, "tokens"), tokenizer)
    n, cores = files.count(), docs.sparkSession.sparkContext.defaultParallelism
    return placed(files).select("name", "start").repartition(max(min(n, max(4 * cores, n // 64)), 1)).transform(arrow(_digests(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
