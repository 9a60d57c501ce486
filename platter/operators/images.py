"""Tables of files to images and archives: a volume is written whole, from a snapshot of its entries, in one task; many volumes are
written in parallel. (W08, W12, W14, W17, W18; M04, M05, M07, M08 as changes of the table before it is written)"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from platter.codecs import lzh
from platter.parse import fat, ffs, pfs

from .dealing import dealt

#: Files of a task, where volumes are not larger: what is written there meets the reader in one batch.
FILES_EACH = 2000
IMAGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def _written(files: DataFrame, suffix: str, of: Callable[[str, list[tuple[str, bytes]]], bytes]) -> DataFrame:
    """files: volume, path, content; a row (path, content) for each volume."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = group["volume"].iloc[0]
        rows = [(p, bytes(c or b"")) for p, c in zip(group["path"], group["content"], strict=True)]
        return pd.DataFrame({"path": [f"{name}{suffix}"], "content": [of(name, rows)]})

    return dealt(files.select("volume", "path", "content"), "volume", FILES_EACH).groupBy("volume").applyInPandas(run, IMAGE)


def amiga_image(name: str, rows: list[tuple[str, bytes]], dos_type: int = 0x444F5303) -> bytes:
    need = sum(3 + len(c) // 488 + len(c) // 30_000 for _, c in rows) + 2 * len({p.rpartition("/")[0] for p, _ in rows}) * 4
    total = max(1760, need + need // 100 + 64)
    return ffs.write(ffs.Volume(name, dos_type, 512, total, [ffs.Entry(p, False, c) for p, c in rows]))


def fat_image(name: str, rows: list[tuple[str, bytes]]) -> bytes:
    need = sum(2 + len(c) // 512 for _, c in rows) + len(rows) + 64
    v = fat.blank(32 + need + need // 32 + 128, name, 1)
    v.entries = [fat.Entry(p, False, c) for p, c in rows]
    return fat.write(v)


def amiga_images(files: DataFrame, dos_type: int = 0x444F5303) -> DataFrame:
    return _written(files, ".adf", lambda name, rows: amiga_image(name, rows, dos_type))


def pfs_image(name: str, rows: list[tuple[str, bytes]]) -> bytes:
    need = sum(1 + len(c) // 512 for _, c in rows) + len(rows) * 2 + 512
    return pfs.write(pfs.Volume(name, need + need // 8, [pfs.Entry(p, False, c) for p, c in rows]))


def pfs_images(files: DataFrame) -> DataFrame:
    return _written(files, ".hdf", pfs_image)


def fat_images(files: DataFrame) -> DataFrame:
    return _written(files, ".img", fat_image)


def archives(files: DataFrame, store: bool = False) -> DataFrame:
    return _written(files, ".lha", lambda _, rows: lzh.archive(rows, store))
