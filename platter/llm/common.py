"""What the operators share: shared storage, flat text batches and rolling hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one numpy pass holds; a longer document makes a pass of its own.
CHUNK_BYTES = 500_000

#: A word is a run of bytes that are none of these (ASCII white space never occurs inside a UTF-8 sequence).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one in spark.checkpoint.dir; where that is unset and the driver runs
    all tasks itself (tests), a temporary one that is then set as the checkpoint folder. On a cluster it must be set."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (kept := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return kept.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="platter-")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/platter/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_folder(spark, name))
    read = spark.read.schema(df.schema).parquet(path)
    read.platter_path = path  # type: ignore[attr-defined]
    return read


def drop_table(*frames: DataFrame) -> None:
    """Deletes what table() has written, when nothing lazy reads it any more."""
    for df in frames:
        remove(df.sparkSession, df.platter_path)  # type: ignore[attr-defined]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of about `most` bytes, so that runs of very long texts don't fill a worker."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", most), ("spark.sql.execution.arrow.maxRecordsPerBatch", most >> 11)):
        spark.conf.set(key, value)


def _give_back() -> None:
    """Returns what a finished task has freed to the machine; workers stay for other tasks, and several wait at a time."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: f over the Arrow batches of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return lambda df: df.mapInArrow(run, schema)


def flat(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each starts (one more at the end). A null is an empty text."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return (LOWER[raw] if lower else raw), at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes together; each document is in exactly one, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Rolling:
    """Hashes of substrings modulo 2^64 from prefix sums: of bytes i to j-1, (sum[j] - sum[i]) / base^i. Used to find
    candidates and, mixed, as 64-bit identities of short strings."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    _table = np.random.RandomState(20240607).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray | None = None, values: np.ndarray | None = None):
        """data: bytes; or values: any symbols, as 64-bit hashes of their own."""
        values = Rolling._table[data] if values is None else values
        n = len(values) + 1
        if len(Rolling._up) < n:
            size = max(n, 1 << 19)
            for name, by in (("_up", self.BASE), ("_down", self.INVERSE)):
                steps = np.full(size, by, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * Rolling._up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Rolling._down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; no word crosses a document's end. outside: which bytes are part of no word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~outside[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def per_doc(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value per byte over each document."""
    sums = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def twice(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its (group, key) occurs at least twice, and whether it occurred earlier."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = np.zeros(len(k), bool)
    same[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    again = same.copy()
    again[:-1] |= same[1:]
    repeated, earlier = np.zeros(len(k), bool), np.zeros(len(k), bool)
    repeated[order], earlier[order] = again, same
    return repeated, earlier
