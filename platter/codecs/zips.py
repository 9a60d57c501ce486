"""ZIP archives with the traditional encryption, and .Z files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from platter.functions.checksums import byte_table

_CRC = byte_table(0xEDB88320)


@dataclass
class Entry:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    offset: int
    attributes: int


def entries(raw: bytes) -> list[Entry]:
    """The central directory, found from the end of the file."""
    at = raw.rfind(b"PK\5\6", max(0, len(raw) - 65_557))
    if at < 0:
        raise ValueError("no end of a central directory")
    n, _, pos = struct.unpack_from("<HII", raw, at + 10)
    out = []
    for _ in range(n):
        if raw[pos : pos + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", raw, pos + 8)
        crc, packed, size, a, b, c = struct.unpack_from("<IIIHHH", raw, pos + 16)
        attributes, offset = struct.unpack_from("<II", raw, pos + 38)
        name = raw[pos + 46 : pos + 46 + a]
        out.append(Entry(name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, flags, crc, packed, size, offset, attributes))
        pos += 46 + a + b + c
    return out


def _update(crc: int, b: int) -> int:
    return crc >> 8 ^ _CRC[(crc ^ b) & 255]


def decrypted(raw: bytes, password: bytes) -> bytes:
    """Without its header of 12 bytes."""
    a, b, c = 0x12345678, 0x23456789, 0x34567890

    def feed(x: int) -> None:
        nonlocal a, b, c
        a = _update(a, x)
        b = ((b + (a & 255)) * 134_775_813 + 1) & 0xFFFFFFFF
        c = _update(c, b >> 24)

    for x in password:
        feed(x)
    out = bytearray()
    for x in raw:
        t = (c | 2) & 0xFFFF
        x ^= (t * (t ^ 1) >> 8) & 255
        feed(x)
        out.append(x)
    return bytes(out[12:])


def content(raw: bytes, e: Entry, password: bytes = b"") -> bytes:
    a, b = struct.unpack_from("<HH", raw, e.offset + 26)
    at = e.offset + 30 + a + b
    data = raw[at : at + e.packed]
    if e.flags & 1:
        data = decrypted(data, password)
    try:
        got = data if e.method == 0 else zlib.decompress(data, -15) if e.method == 8 else None
    except zlib.error as x:
        raise ValueError(f"{e.name}: {x}") from x
    if got is None:
        raise ValueError(f"{e.name}: method {e.method} is not supported")
    if len(got) != e.size or zlib.crc32(got) != e.crc:
        raise ValueError(f"{e.name}: size or checksum do not match")
    return got


def safe(name: str) -> bool:
    """Names that stay below the folder they are written to."""
    return not name.startswith("/") and ".." not in name.split("/")


CLEAR, FIRST = 256, 257


def uncompress(raw: bytes) -> bytes:
    """.Z: codes of 9 bits and more, least significant bit first, in groups of eight codes of one width."""
    if raw[:2] != b"\x1f\x9d":
        raise ValueError("not a .Z file")
    most, block = raw[2] & 31, raw[2] & 128
    table: list[bytes] = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    out, last = [], b""
    width, bit = 9, 24
    total, full = len(raw) * 8, 1 << most
    while bit + width <= total:
        # codes of one width from a whole byte on, as many as follow before the width grows
        count = (total - bit) // width
        if width < most:
            count = min(count, max(1, (1 << width) - len(table) + (not last)))
        codes = _codes(raw[bit // 8 : (bit + count * width + 7) // 8], width, count)
        clear = np.flatnonzero(codes == CLEAR) if block else codes[:0]
        codes = codes[: clear[0] if len(clear) else count].tolist()
        size = len(table)
        for code in codes:
            if code < size:
                now = table[code]
            elif code == size and last:
                now = last + last[:1]
            else:
                raise ValueError("a code beyond the table")
            out.append(now)
            if last and size < full:
                table.append(last + now[:1])
                size += 1
            last = now
        done = len(codes) + (len(clear) > 0)
        bit += -(-done // 8) * width * 8
        if len(clear):
            width, last = 9, b""
            del table[FIRST:]
        elif size >= 1 << width and width < most:
            width += 1
        else:
            break
    return b"".join(out)


def _codes(raw: bytes, width: int, count: int) -> np.ndarray:
    """So many numbers of width bits, least significant bit first, each from the four bytes that hold it."""
    b = np.frombuffer(raw + bytes(4), np.uint8).astype(np.int64)
    at = np.arange(count) * width
    k = at >> 3
    return (b[k] | b[k + 1] << 8 | b[k + 2] << 16 | b[k + 3] << 24) >> (at & 7) & (1 << width) - 1


#: Codes whose bits are laid side by side; whole bytes of any width.
SIDE = 1 << 16


def compress(raw: bytes, most: int = 16) -> bytes:
    """A .Z file in block mode that never clears its table."""
    table: dict[int, int] = {}  # by the code of a phrase and the byte behind it
    codes: list[int] = []
    put, known = codes.append, table.get
    following, full = FIRST, 1 << most
    now = raw[0] if raw else 0
    for x in raw[1:]:
        key = now << 8 | x
        longer = known(key)
        if longer is not None:
            now = longer
            continue
        put(now)
        if following < full:
            table[key] = following
            following += 1
        now = x
    if raw:
        put(now)
    parts, at, width = [b"\x1f\x9d" + bytes([128 | most])], 0, 9
    while at < len(codes):
        end = len(codes) if width >= most else (1 << width) - FIRST + 1  # the code after which the table needs more bits; all widths hold groups of eight
        some = np.array(codes[at:end], np.int64)
        for k in range(0, len(some), SIDE):
            bits = (some[k : k + SIDE, None] >> np.arange(width) & 1).astype(np.uint8)
            parts.append(np.packbits(bits, bitorder="little").tobytes())
        at, width = end, width + 1
    return b"".join(parts)
