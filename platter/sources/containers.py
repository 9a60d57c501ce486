"""Images and archives as tables.

Files come in as (path, content), as spark.read.format("binaryFile") gives them; each is parsed in one task, so parallelism is
over files. What cannot be read becomes a row with `error`; the other files of the table are not affected. (U01, U06, X01, X02,
X08 to X12, S50)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.codecs import lzh, zips
from platter.parse import fat, ffs, iso, partitions, pfs

ENTRIES = "image string, volume string, path string, parent string, name string, is_dir boolean, size bigint, protection bigint, modified timestamp, comment string, note string, error string"
CONTENTS = "image string, volume string, path string, content binary, error string"
PARTITIONS = "image string, scheme string, name string, type bigint, start_byte bigint, size bigint, bootable boolean, priority int, block_size int, error string"
EXTENSIONS = ("adf", "hdf", "img", "dmg", "lha", "lzh", "zip", "iso")
FAT_TYPES = (0x0B, 0x0C)

#: An entry: volume, path, is_dir, size, protection, modified, comment, note, and how to get its content.
Row = tuple[str, str, bool, int, int | None, datetime | None, str | None, str | None, Callable[[], bytes]]


def is_container(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*EXTENSIONS)


def _date(day: int, minute: int, tick: int) -> datetime | None:
    if not (day or minute or tick):
        return None
    return datetime(1978, 1, 1, tzinfo=timezone.utc) + timedelta(days=day, minutes=minute, microseconds=tick * 20_000)


def _dos_date(stamp: int) -> datetime | None:
    d, t = stamp >> 16, stamp & 0xFFFF
    try:
        return datetime(1980 + (d >> 9), d >> 5 & 15, d & 31, t >> 11, t >> 5 & 63, min(59, (t & 31) * 2), tzinfo=timezone.utc)
    except ValueError:
        return None


def _amiga(name: str | None, raw: bytes, kind: int | None, size: int, reserved: int) -> Iterator[Row]:
    is_pfs = raw[:4] == b"PFS\1" or (kind or 0) >> 8 in (0x504653, 0x504453)
    v = pfs.read(raw) if is_pfs else ffs.read(raw, kind, size, reserved)
    for e in v.entries:
        yield name or v.name, e.path, e.is_dir, e.size, e.protection, _date(*e.date), e.comment, e.note, lambda e=e: e.content


def _fat(raw: bytes) -> Iterator[Row]:
    for e in fat.read(raw).entries:
        yield "BOOT", e.path, e.is_dir, e.size, None, _dos_date(e.stamp), None, e.note, lambda e=e: e.content


def volumes(raw: bytes) -> Iterator[tuple[str, int, int, Callable[[], Iterator[Row]]]]:
    """The volumes of a block image in order: name, start, size and how to read it: slots of a PC table that hold FAT, then the
    partitions of an Amiga disk; without either, the image itself."""
    found = False
    for s in partitions.pc_slots(raw[:512]):
        if s.type in FAT_TYPES:
            found = True
            part = raw[s.first * 512 : (s.first + s.sectors) * 512]
            yield "BOOT", s.first * 512, s.sectors * 512, lambda part=part: _fat(part)
    try:
        disk = partitions.read_disk(raw)
    except ValueError:
        disk = None
    for p in disk.partitions if disk else ():
        found = True
        at = disk.slice_lba * 512 + p.start
        part = raw[at : at + p.size]
        yield p.name, at, p.size, lambda p=p, part=part: _amiga(p.name, part, p.dos_type, p.block_size, p.reserved)
    if not found:
        if raw[:3] in (b"DOS", b"PFS"):
            yield "", 0, len(raw), lambda: _amiga(None, raw, None, 512, 2)
        else:
            yield "BOOT", 0, len(raw), lambda: _fat(raw)


def rows(raw: bytes) -> Iterator[Row | tuple[str, str]]:
    """All entries of a container; (volume, problem) where a volume cannot be read."""
    if raw[2:5] == b"-lh" or raw[2:5] == b"-lz":
        for m in lzh.members(raw):
            yield "", m.path, m.is_dir, m.size, None, None, None, None, lambda m=m: lzh.content(raw, m)
    elif raw[:4] in (b"PK\3\4", b"PK\5\6"):
        for e in zips.entries(raw):
            yield "", e.name.rstrip("/"), e.name.endswith("/"), e.size, None, None, None, None if zips.safe(e.name) else "unsafe name", lambda e=e: zips.content(raw, e)
    elif raw[0x8001:0x8006] == b"CD001":
        name, found = iso.read(raw)
        for x in found:
            yield name, x.path, x.is_dir, x.size, None, x.modified, None, None, lambda x=x: iso.content(raw, x)
    else:
        for name, _, _, opened in volumes(raw):
            try:
                yield from opened()
            except (ValueError, IndexError) as problem:
                yield name, str(problem)
            except Exception as problem:  # a damaged structure can fail anywhere; the row says how
                yield name, f"{type(problem).__name__}: {problem}"


def _each(batches: Iterator[pa.RecordBatch], names: list[str], types: list[pa.DataType], of: Callable[[str, bytes], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, path in enumerate(batch["path"].to_pylist()):
            raw = batch["content"][k].as_py()  # one image at a time
            out: list[tuple] = []
            try:
                for r in of(path, raw or b""):
                    out.append(r)
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
            except Exception as problem:
                out.append((path, *[None] * (len(names) - 2), f"{type(problem).__name__}: {problem}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary()}


def _scan(files: DataFrame, schema: str, of: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = [_ARROW[k] for k in kinds]
    return files.select("path", "content").mapInArrow(lambda it: _each(it, list(names), types, of), schema)


def entries(files: DataFrame) -> DataFrame:
    """All entries of all containers."""

    def of(image: str, raw: bytes) -> Iterator[tuple]:
        for r in rows(raw):
            if len(r) == 2:
                yield image, r[0], *[None] * 9, r[1]
            else:
                volume, path, is_dir, size, protection, modified, comment, note, _ = r
                parent, _, name = path.rpartition("/")
                yield image, volume, path, parent, name, is_dir, 0 if is_dir else size, protection, modified, comment, note, None

    return _scan(files, ENTRIES, of)


def contents(files: DataFrame) -> DataFrame:
    """The contents of all files in all containers; a file that fails its checks has an error."""

    def of(image: str, raw: bytes) -> Iterator[tuple]:
        for r in rows(raw):
            if len(r) == 2:
                yield image, r[0], None, None, r[1]
            elif not r[2]:
                try:
                    yield image, r[0], r[1], r[8](), r[7]
                except ValueError as problem:
                    yield image, r[0], r[1], None, str(problem)

    return _scan(files, CONTENTS, of)


def partition_table(files: DataFrame) -> DataFrame:
    """Partition tables of block images."""

    def of(image: str, raw: bytes) -> Iterator[tuple]:
        for s in partitions.pc_slots(raw[:512]):
            if s.type or s.first or s.sectors:
                yield image, "pc", str(s.slot), s.type, s.first * 512, s.sectors * 512, s.bootable, None, 512, None
        try:
            disk = partitions.read_disk(raw)
        except ValueError as problem:
            yield image, "rdb", *[None] * 7, str(problem)
            return
        for p in disk.partitions:
            yield image, "rdb", p.name, p.dos_type, p.start, p.size, p.bootable, p.priority, p.block_size, None
        for problem in disk.problems:
            yield image, "rdb", *[None] * 7, problem

    return _scan(files, PARTITIONS, of)


def inspect(files: DataFrame) -> DataFrame:
    """A roll-up of each volume: items, files, bytes, deepest level, first problem."""
    e = entries(files)
    depth = F.size(F.split("path", "/"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return e.groupBy("image", "volume").agg(count(F.col("path").isNotNull()).alias("items"), count(F.col("is_dir") == F.lit(False)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max(depth).cast("long").alias("deepest"), F.min("error").alias("error"))
