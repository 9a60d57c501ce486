"""Checksums of contents. What has no built-in runs over Arrow batches."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_table(poly: int) -> list[int]:
    """The table of a reflected CRC: what each byte adds."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ poly * (b & 1)
        out.append(b)
    return out


_TABLE16 = byte_table(0xA001)


@functools.cache
def _two() -> list[int]:
    """Where two zero bytes take each state."""
    table = np.array(_TABLE16, np.uint16)
    state = np.arange(1 << 16, dtype=np.uint16)
    for _ in range(2):
        state = (state >> 8) ^ table[state & 255]
    return state.tolist()


def crc16_of(raw: bytes) -> int:
    """CRC-16 with the polynomial 0xA001, from 0, two bytes at a time; a zero in front leaves a sum from 0 as it is."""
    c, two = 0, _two()
    for b in np.frombuffer(b"\0" * (len(raw) % 2) + raw, "<u2").tolist():
        c = two[c ^ b]
    return c


def _raw(x: object) -> bytes:
    return b"" if x is None else x.encode() if isinstance(x, str) else bytes(x)  # type: ignore[arg-type]


#: Bytes of a block; blocks of all texts of a batch are summed side by side.
BLOCK = 64


@functools.cache
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte, and where BLOCK zero bytes take each state."""
    table = np.array(_TABLE16, np.uint16)
    state = np.arange(1 << 16, dtype=np.uint16)
    for _ in range(BLOCK):
        state = (state >> 8) ^ table[state & 255]
    return table, state


def crc16_many(contents: list[bytes]) -> np.ndarray:
    """crc16_of for many. Zeros in front leave a sum from 0 as it is, so contents are filled up to whole blocks there; as the sum is
    linear, that of two blocks is the first one's, taken on by a block of zeros, with the second one's."""
    table, onward = _steps()
    count = np.array([-(-len(x) // BLOCK) for x in contents], np.int64)
    rows = np.frombuffer(b"".join(x.rjust(n * BLOCK, b"\0") for x, n in zip(contents, count.tolist(), strict=True)), np.uint8).reshape(-1, BLOCK)
    c = np.zeros(len(rows), np.uint16)
    for column in rows.T:
        c = (c >> 8) ^ table[(c ^ column) & 255]
    out, at = np.zeros(len(contents), np.int64), 0
    on, sums = onward.tolist(), c.tolist()
    for i, n in enumerate(count.tolist()):
        state = 0
        for x in sums[at : at + n]:
            state = on[state] ^ x
        out[i], at = state, at + n
    return out


@F.pandas_udf(T.LongType())  # type: ignore[call-overload]
def _crc16(s: pd.Series) -> pd.Series:
    return pd.Series(crc16_many([_raw(x) for x in s]), index=s.index, dtype="Int64").mask(s.isna())


def crc16(content: Column | str) -> Column:
    """(A06) Null stays null."""
    return _crc16(content)


def long_sum(raw: bytes) -> int:
    """The sum of big-endian longs modulo 2^32; a last part is padded with zeros."""
    return int(np.frombuffer(raw + bytes(-len(raw) % 4), ">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF


def carry_sum(raw: bytes) -> int:
    """The sum of big-endian longs with the carry added at the low end."""
    total = int(np.frombuffer(raw + bytes(-len(raw) % 4), ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


@F.pandas_udf(T.StructType([T.StructField("sum32", T.LongType()), T.StructField("sum8", T.LongType())]))  # type: ignore[call-overload]
def _sums(s: pd.Series) -> pd.DataFrame:
    raws = [_raw(x) for x in s]
    return pd.DataFrame({"sum32": [long_sum(r) for r in raws], "sum8": [int(np.frombuffer(r, np.uint8).sum(dtype=np.uint64)) & 255 for r in raws]})


def sums(content: Column | str) -> Column:
    """A struct of the sum of longs and of bytes."""
    return _sums(content)
