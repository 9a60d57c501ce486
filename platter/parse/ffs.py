"""Amiga volumes: DOS\\0 to DOS\\7, blocks of 512 bytes and more. A volume is read into entries, and written whole from entries, so
a change is a new snapshot. (S17 to S21, P01, P19, W11, W12, M01 to M10, F59, A02 to A04)"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from platter.functions.checksums import carry_sum, long_sum

from .partitions import bstr, put_bstr, sealed

END = 0xFFFFFFFF
HEADER, LIST, DATA = 2, 16, 8
ROOT, FOLDER, FILE = 1, 2, -3
LONG_NAMES = (0x444F5306, 0x444F5307)
MAX_NAME, MAX_LONG_NAME, MAX_COMMENT = 30, 109, 79


@dataclass
class Entry:
    path: str
    is_dir: bool
    content: bytes = b""
    protection: int = 0
    date: tuple[int, int, int] = (0, 0, 0)
    comment: str = ""
    block: int = 0
    size: int = 0
    note: str | None = None


@dataclass
class Volume:
    name: str
    dos_type: int
    block_size: int
    total: int
    entries: list[Entry] = field(default_factory=list)
    free: int = 0
    problems: list[str] = field(default_factory=list)


def folded(name: str, international: bool) -> bytes:
    raw = bytearray(name.encode("latin-1", "replace"))
    for i, c in enumerate(raw):
        if 0x61 <= c <= 0x7A or (international and 0xE0 <= c <= 0xFE and c != 0xF7):
            raw[i] = c - 32
    return bytes(raw)


def slot_of(name: str, slots: int, international: bool) -> int:
    h = len(name.encode("latin-1", "replace"))
    for c in folded(name, international):
        h = (h * 13 + c) & 0x7FF
    return h % slots if slots > 0 else 0


def is_international(dos_type: int) -> bool:
    return dos_type & 0xFF >= 2 and dos_type >> 8 == 0x444F53


def has_data_headers(dos_type: int) -> bool:
    return dos_type & 1 == 0


def _longs(block: bytes, at: int, n: int) -> tuple[int, ...]:
    return struct.unpack_from(f">{n}I", block, at)


def read(raw: bytes, dos_type: int | None = None, block_size: int = 512, reserved: int = 2) -> Volume:
    """All entries that the root reaches, parents first. Damaged blocks and links become problems or notes."""
    kind = struct.unpack_from(">I", raw, 0)[0] if dos_type is None else dos_type
    if raw[:3] != b"DOS":
        raise ValueError("no boot block of such a volume")
    long_names = kind in LONG_NAMES
    bs, total = block_size, len(raw) // block_size
    block = lambda n: raw[n * bs : (n + 1) * bs]
    root_nr = (total - 1 + reserved) // 2 if struct.unpack_from(">I", block((total) // 2), 0)[0] != HEADER else total // 2
    root = block(root_nr)
    if long_sum(root) or struct.unpack_from(">I", root, 0)[0] != HEADER or struct.unpack_from(">i", root, bs - 4)[0] != ROOT:
        raise ValueError("no root block")
    out = Volume(bstr(root, bs - 80, 32), kind, bs, total)
    out.free = _free(raw, root, bs, total, reserved)
    slots = bs // 4 - 56
    todo, seen = [("", root)], {root_nr}
    while todo:
        parent, b = todo.pop(0)
        for head in _longs(b, 24, slots):
            while head:
                if head >= total or head in seen:
                    out.problems.append(f"block {head}: out of range or met twice")
                    break
                seen.add(head)
                e = block(head)
                if long_sum(e):
                    out.problems.append(f"block {head}: checksum")
                    break
                (sec,) = struct.unpack_from(">i", e, bs - 4)
                # long names take the place of comments, and push the date back
                name, comment, date = (bstr(e, bs - 184, 112), "", bs - 60) if long_names else (bstr(e, bs - 80, 32), bstr(e, bs - 184, 80), bs - 92)
                path = f"{parent}/{name}".lstrip("/")
                entry = Entry(path, sec == FOLDER, b"", _longs(e, bs - 192, 1)[0], _longs(e, date, 3), comment, head)  # type: ignore[arg-type]
                if sec == FOLDER:
                    todo.append((path, e))
                elif sec == FILE:
                    entry.size = _longs(e, bs - 188, 1)[0]
                    entry.content = _content(block, e, bs, entry.size, has_data_headers(kind), total)
                    if len(entry.content) < entry.size:
                        entry.note = "cut"
                else:
                    entry.note = "link"
                out.entries.append(entry)
                (head,) = _longs(e, bs - 16, 1)
    return out


def _content(block, header: bytes, bs: int, size: int, headers: bool, total: int) -> bytes:
    parts, n, e = [], 0, header
    for _ in range(total):
        (count,) = _longs(e, 8, 1)
        for p in reversed(_longs(e, 24, bs // 4 - 56)[-count:] if count else ()):
            if not 0 < p < total:
                return b"".join(parts)
            d = block(p)
            if headers and _longs(d, 0, 1)[0] == DATA:
                d = d[24 : 24 + min(_longs(d, 12, 1)[0], bs - 24)]
            parts.append(d)
            n += len(d)
        (ext,) = _longs(e, bs - 8, 1)
        if not ext or ext >= total or n >= size:
            break
        e = block(ext)
    return b"".join(parts)[:size]


def _free(raw: bytes, root: bytes, bs: int, total: int, reserved: int) -> int:
    pages = [p for p in _longs(root, bs - 196, 25) if p]
    (ext,) = _longs(root, bs - 96, 1)
    for _ in range(256):
        if not ext or ext >= total:
            break
        e = raw[ext * bs : (ext + 1) * bs]
        *more, ext = _longs(e, 0, bs // 4)
        pages += [p for p in more if p]
    left, n = total - reserved, 0
    for p in pages:
        for w in _longs(raw[p * bs : (p + 1) * bs], 4, bs // 4 - 1):
            k = min(32, left)
            if k <= 0:
                break
            n += (w & (1 << k) - 1).bit_count()
            left -= k
    return n


def write(volume: Volume, reserved: int = 2) -> bytes:
    """The volume with all its entries; parents that are missing are made. Blocks are taken in order behind the root, then from
    the start, so equal entries give equal bytes."""
    bs, total, kind = volume.block_size, volume.total, volume.dos_type
    long_names = kind in LONG_NAMES
    most = MAX_LONG_NAME if long_names else MAX_NAME
    slots, inter, headers = bs // 4 - 56, is_international(kind), has_data_headers(kind)
    room = bs - 24 if headers else bs
    root = total // 2
    per_page = (bs // 4 - 1) * 32
    n_pages = -(-(total - reserved) // per_page)
    n_ext = max(0, -(-(n_pages - 25) // (bs // 4 - 1)))
    pages = list(range(root + 1, root + 1 + n_pages))
    exts = list(range(root + 1 + n_pages, root + 1 + n_pages + n_ext))
    after = root + 1 + n_pages + n_ext
    order = iter([*range(after, total), *range(reserved, root)])
    used = {root, *pages, *exts}
    blocks: dict[int, bytearray] = {}

    def take() -> int:
        n = next(order, None)
        if n is None:
            raise ValueError("the volume is full")
        used.add(n)
        return n

    entries: dict[str, Entry] = {}
    for e in sorted(volume.entries, key=lambda e: (e.path.count("/"), e.path)):
        parts = [p for p in e.path.split("/") if p]
        for i in range(1, len(parts)):
            up = "/".join(parts[:i])
            if up in entries and not entries[up].is_dir:
                raise ValueError(f"{up} is a file")
            entries.setdefault(up, Entry(up, True))
        path = "/".join(parts)
        if path in entries and not (entries[path].is_dir and e.is_dir):
            raise ValueError(f"{path} is there twice")
        entries[path] = e
    number = {"": root}
    tables: dict[str, list[int]] = {"": [0] * slots}
    for path, e in sorted(entries.items(), key=lambda x: (x[0].count("/"), x[0])):
        parent, _, name = path.rpartition("/")
        name = name.encode("latin-1", "replace")[:most].decode("latin-1")
        nr = number[path] = take()
        b = blocks[nr] = bytearray(bs)
        struct.pack_into(">II", b, 0, HEADER, nr)
        struct.pack_into(">I", b, bs - 192, e.protection & END)
        if long_names:
            if e.comment:
                raise ValueError(f"{path}: no comments on volumes with long names")
            put_bstr(b, bs - 184, name, 112)
            struct.pack_into(">III", b, bs - 60, *e.date)
        else:
            put_bstr(b, bs - 184, e.comment, MAX_COMMENT + 1)
            struct.pack_into(">III", b, bs - 92, *e.date)
            put_bstr(b, bs - 80, name, 32)
        slot = slot_of(name, slots, inter)
        struct.pack_into(">II", b, bs - 16, tables[parent][slot], number[parent])
        tables[parent][slot] = nr
        struct.pack_into(">i", b, bs - 4, FOLDER if e.is_dir else FILE)
        if e.is_dir:
            tables[path] = [0] * slots
            continue
        struct.pack_into(">I", b, bs - 188, len(e.content))
        data = [take() for _ in range(0, len(e.content), room)]
        for k, d in enumerate(data):
            part = e.content[k * room : (k + 1) * room]
            if headers:
                h = bytearray(bs)
                struct.pack_into(">IIIII", h, 0, DATA, nr, k + 1, len(part), data[k + 1] if k + 1 < len(data) else 0)
                h[24 : 24 + len(part)] = part
                blocks[d] = bytearray(sealed(h, 20))
            else:
                blocks[d] = bytearray(part.ljust(bs, b"\0"))
        now, holder = b, nr
        for k in range(0, max(len(data), 1), slots):
            group = data[k : k + slots]
            if k:
                x = take()
                struct.pack_into(">I", now, bs - 8, x)
                if holder != nr:
                    blocks[holder] = bytearray(sealed(now, 20))
                now, holder = blocks.setdefault(x, bytearray(bs)), x
                struct.pack_into(">II", now, 0, LIST, x)
                struct.pack_into(">Ii", now, bs - 12, nr, 0)
                struct.pack_into(">i", now, bs - 4, FILE)
            struct.pack_into(">I", now, 8, len(group))
            struct.pack_into(f">{len(group)}I", now, 24 + 4 * (slots - len(group)), *reversed(group))
        if data:
            struct.pack_into(">I", b, 16, data[0])
        if holder != nr:
            blocks[holder] = bytearray(sealed(now, 20))
    r = blocks[root] = bytearray(bs)
    struct.pack_into(">IIII", r, 0, HEADER, 0, 0, slots)
    struct.pack_into(">I", r, bs - 200, END)
    struct.pack_into(f">{min(25, n_pages)}I", r, bs - 196, *pages[:25])
    struct.pack_into(">I", r, bs - 96, exts[0] if exts else 0)
    put_bstr(r, bs - 80, volume.name[:MAX_NAME], 32)
    struct.pack_into(">i", r, bs - 4, ROOT)
    for path, t in tables.items():
        struct.pack_into(f">{slots}I", blocks[number[path]], 24, *t)
    for nr in number.values():
        blocks[nr] = bytearray(sealed(blocks[nr], 20))
    per = bs // 4 - 1
    for i, x in enumerate(exts):
        b = bytearray(bs)
        own = pages[25 + i * per : 25 + (i + 1) * per]
        struct.pack_into(f">{len(own)}I", b, 0, *own)
        struct.pack_into(">I", b, bs - 4, exts[i + 1] if i + 1 < len(exts) else 0)
        blocks[x] = b
    for i, p in enumerate(pages):
        bits = bytearray(bs)
        first = reserved + i * per_page
        for w in range(per):
            value = 0
            for k in range(32):
                n = first + w * 32 + k
                if n < total and n not in used:
                    value |= 1 << k
            struct.pack_into(">I", bits, 4 + 4 * w, value)
        blocks[p] = bytearray(sealed(bits, 0))
    out = bytearray(total * bs)
    for n, b in blocks.items():
        out[n * bs : (n + 1) * bs] = b
    boot = bytearray(1024)
    struct.pack_into(">III", boot, 0, kind, 0, root)
    struct.pack_into(">I", boot, 4, END - carry_sum(bytes(boot)))
    out[:1024] = boot
    return bytes(out)


def boot_valid(raw: bytes) -> bool:
    """(A04)"""
    return carry_sum(raw[:1024]) == END
