"""PFS3 volumes with reserved blocks of 1,024 bytes: read into entries, written whole from entries. (S23 to S28, P02, P06, P20, W13,
W16, J02, J06, J10 to J12, F60, M11 to M17 as changes of the entries)"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .partitions import bstr, put_bstr

DISK = 0x50465301
SECTOR, RESERVED = 512, 1024
ROOT_AT, ROOT_FOLDER, FIRST_USER = 2, 5, 6
HARD_DISK, SPLIT, EXTENSIONS, DELETED, SIZES, EXTENSION_BLOCK, STAMPED, SUPER, LARGE = 1, 2, 4, 8, 16, 32, 64, 128, 2048
PER_ANODES, PER_INDEX, PER_BITMAP = (RESERVED - 16) // 12, (RESERVED - 12) // 4, RESERVED // 4 - 3
SMALL_BITMAPS, SMALL_INDEXES = 5, 99
FOLDER, FILE = 2, -3
MAX_NAME = 106


@dataclass
class Entry:
    path: str
    is_dir: bool
    content: bytes = b""
    protection: int = 0
    date: tuple[int, int, int] = (0, 0, 0)
    comment: str = ""
    size: int = 0
    note: str | None = None


@dataclass
class Volume:
    name: str
    sectors: int
    entries: list[Entry] = field(default_factory=list)
    free: int = 0
    problems: list[str] = field(default_factory=list)


class _Tree:
    """Anodes by number: each is (sectors, first sector, next anode)."""

    def __init__(self, raw: bytes, root: bytes):
        self.raw = raw
        (self.options,) = struct.unpack_from(">I", root, 4)
        self.index = struct.unpack_from(">104I", root, 0x60)
        (ext,) = struct.unpack_from(">I", root, 0x58)
        self.supers = struct.unpack_from(">16I", self.block(ext, b"EX"), 64) if self.options & SUPER and ext else ()

    def block(self, nr: int, kind: bytes) -> bytes:
        b = self.raw[nr * SECTOR : nr * SECTOR + RESERVED]
        if b[:2] != kind or len(b) < RESERVED:
            raise ValueError(f"block {nr} is no {kind.decode()}")
        return b

    def anode(self, nr: int) -> tuple[int, int, int]:
        seq, at = (nr >> 16, nr & 0xFFFF) if self.options & SPLIT else divmod(nr, PER_ANODES)
        index_nr, place = divmod(seq, PER_INDEX)
        if self.supers:
            block, inner = divmod(index_nr, PER_INDEX)
            where = struct.unpack_from(">I", self.block(self.supers[block], b"SB"), 12 + 4 * inner)[0]
        else:
            where = self.index[SMALL_BITMAPS + index_nr]
        (at_block,) = struct.unpack_from(">I", self.block(where, b"IB"), 12 + 4 * place)
        return struct.unpack_from(">III", self.block(at_block, b"AB"), 16 + 12 * at)  # type: ignore[return-value]

    def extents(self, nr: int) -> list[tuple[int, int]]:
        out, seen = [], set()
        while nr and nr not in seen:
            seen.add(nr)
            size, first, nr = self.anode(nr)
            if size and first != 0xFFFFFFFF:
                out.append((first, size))
        return out


def records(block: bytes, extra: bool) -> list[tuple[int, int, int, int, tuple[int, int, int], str, str]]:
    """(type, anode, size, protection, date, name, comment) of a directory block. Further fields lie before the flags at the end of
    an entry, from the last to the first; one of them is the upper part of the protection."""
    out, at = [], 20
    while at < len(block) and (n := block[at]):
        if n < 18 or at + n > len(block):
            raise ValueError(f"an entry of {n} bytes")
        kind, anode, size, *date, low, length = struct.unpack_from(">bIIHHHBB", block, at + 1)
        name = block[at + 18 : at + 18 + length].decode("latin-1")
        c = at + 18 + length
        comment = block[c + 1 : c + 1 + block[c]].decode("latin-1")
        words = [0] * 16
        if extra:
            place = at + n - 2
            (flags,) = struct.unpack_from(">H", block, place)
            for i in range(16):
                if flags >> i & 1:
                    place -= 2
                    (words[i],) = struct.unpack_from(">H", block, place)
        out.append((kind, anode, size, low | (words[4] << 16 | words[5]) & 0xFFFFFF00, (date[0], date[1], date[2]), name, comment))
        at += n
    return out


def read(raw: bytes) -> Volume:
    """All entries that the root reaches, parents first, each directory in its own order."""
    root = raw[ROOT_AT * SECTOR : ROOT_AT * SECTOR + RESERVED]
    kind, options = struct.unpack_from(">II", root, 0) if len(root) >= 512 else (0, 0)
    if kind != DISK or struct.unpack_from(">H", root, 0x40)[0] != RESERVED or options & LARGE or not options & HARD_DISK:
        raise ValueError("no PFS3 volume of the supported kind")
    tree = _Tree(raw, root)
    out = Volume(bstr(root, 0x14, 32), struct.unpack_from(">I", root, 0x54)[0], free=struct.unpack_from(">I", root, 0x44)[0])
    todo, seen = [("", ROOT_FOLDER)], {ROOT_FOLDER}
    while todo:
        parent, anode = todo.pop(0)
        try:
            blocks = [tree.block(first, b"DB") for first, _ in tree.extents(anode)]
            rows = [r for b in blocks for r in records(b, bool(options & EXTENSIONS))]
        except (ValueError, struct.error, IndexError) as x:
            out.problems.append(f"{parent or '/'}: {x}")
            continue
        for kind_, nr, size, protection, date, name, comment in rows:
            e = Entry(f"{parent}/{name}".lstrip("/"), kind_ == FOLDER, b"", protection, date, comment, size)
            if e.is_dir:
                if nr not in seen:
                    seen.add(nr)
                    todo.append((e.path, nr))
            elif kind_ == FILE:
                try:
                    e.content = b"".join(raw[f * SECTOR : (f + n) * SECTOR] for f, n in tree.extents(nr))[:size]
                except (ValueError, struct.error, IndexError) as x:
                    e.note = str(x)
                if len(e.content) < size:
                    e.note = e.note or "cut"
            else:
                e.note = "link"
            out.entries.append(e)
    return out


def _record(e: Entry, name: str, anode: int) -> bytes:
    text, comment = name.encode("latin-1", "replace")[:MAX_NAME], e.comment.encode("latin-1", "replace")[:79]
    high = e.protection & 0xFFFFFF00
    words = [(i, w) for i, w in ((4, high >> 16), (5, high & 0xFFFF)) if w]
    body = struct.pack(">bIIHHHBB", FOLDER if e.is_dir else FILE, anode, 0 if e.is_dir else len(e.content), *e.date, e.protection & 255, len(text)) + text + bytes([len(comment)]) + comment
    body += bytes((len(body) + 1) % 2)
    body += b"".join(struct.pack(">H", w) for _, w in reversed(words)) + struct.pack(">H", sum(1 << i for i, _ in words))
    return bytes([len(body) + 1]) + body


def write(volume: Volume) -> bytes:
    """The volume with all its entries; parents that are missing are made. Files get one extent each, in the order of their paths."""
    entries: dict[str, Entry] = {}
    for e in sorted(volume.entries, key=lambda e: (e.path.count("/"), e.path)):
        parts = [p for p in e.path.split("/") if p]
        for i in range(1, len(parts)):
            entries.setdefault("/".join(parts[:i]), Entry("/".join(parts[:i]), True))
        entries["/".join(parts)] = e
    anode_of, order = {"": ROOT_FOLDER}, sorted(entries)
    free_anodes = (seq << 16 | k for seq in range(1 << 15) for k in range(PER_ANODES) if seq or k >= FIRST_USER)
    for path in order:
        anode_of[path] = next(free_anodes)
    folders: dict[str, list[bytes]] = {d: [] for d in ["", *(p for p in order if entries[p].is_dir)]}
    for path in order:
        parent, _, name = path.rpartition("/")
        r = _record(entries[path], name, anode_of[path])
        blocks = folders[parent]
        if not blocks or len(blocks[-1]) + len(r) + 1 > RESERVED - 20:
            blocks.append(b"")
        blocks[-1] += r
    chained: dict[str, list[int]] = {d: [anode_of[d], *(next(free_anodes) for _ in blocks[1:])] for d, blocks in folders.items()}
    n_anode_blocks = 1 + max(max(x >> 16 for x in c) for c in [*chained.values(), list(anode_of.values())])
    n_indexes = -(-n_anode_blocks // PER_INDEX)
    n_bitmaps = max(1, -(-volume.sectors // (PER_BITMAP * 32)))
    n_maps = -(-n_bitmaps // PER_INDEX)
    if n_indexes > SMALL_INDEXES or n_maps > SMALL_BITMAPS:
        raise ValueError("the volume is too large for small indexes")
    dir_blocks = sum(max(1, len(b)) for b in folders.values())
    n = 1 + n_anode_blocks + n_indexes + n_bitmaps + n_maps + dir_blocks
    n_reserved = -(-(n + 16) // 32) * 32
    cluster = 2 * -(-(SECTOR + 12 + 4 * (n_reserved // 32 + 1)) // RESERVED)
    first, last = ROOT_AT, ROOT_AT + cluster + 2 * n_reserved - 1
    following, data = ROOT_AT + cluster, last + 1
    out = bytearray(volume.sectors * SECTOR)
    if data >= volume.sectors:
        raise ValueError("the volume is full")

    def put(block: bytes | bytearray) -> int:
        nonlocal following
        at = following
        following += 2
        out[at * SECTOR : at * SECTOR + len(block)] = block
        return at

    def numbered(kind: bytes, seq: int, longs: list[int], head: int = 12) -> bytearray:
        b = bytearray(RESERVED)
        struct.pack_into(">2sHII", b, 0, kind, 0, 1, seq)
        struct.pack_into(f">{len(longs)}I", b, head, *longs)
        return b

    anodes: dict[int, tuple[int, int, int]] = {}
    for path in order:
        e = entries[path]
        if not e.is_dir:
            n = -(-len(e.content) // SECTOR)
            if data + n > volume.sectors:
                raise ValueError("the volume is full")
            out[data * SECTOR : data * SECTOR + len(e.content)] = e.content
            anodes[anode_of[path]] = (n, data if n else 0xFFFFFFFF, 0)
            data += n
    for d, blocks in folders.items():
        for k, body in enumerate(blocks or [b""]):
            b = bytearray(RESERVED)
            struct.pack_into(">2sHIIII", b, 0, b"DB", 0, 1, 0, anode_of[d], anode_of[d.rpartition("/")[0]] if d else 0)
            b[20 : 20 + len(body)] = body
            chain = chained[d]
            anodes[chain[k]] = (1, put(b), chain[k + 1] if k + 1 < len(chain) else 0)
    where = []
    for seq in range(n_anode_blocks):
        rows = [anodes.get(seq << 16 | k, (0, 0xFFFFFFFF if not seq and k < ROOT_FOLDER else 0, 0)) for k in range(PER_ANODES)]
        where.append(put(numbered(b"AB", seq, [x for r in rows for x in r], 16)))
    indexes = [put(numbered(b"IB", i, where[i * PER_INDEX : (i + 1) * PER_INDEX])) for i in range(n_indexes)]
    bits = []
    for i in range(n_bitmaps):  # most significant bit first, one for free
        words = []
        for w in range(PER_BITMAP):
            base = last + 1 + (i * PER_BITMAP + w) * 32
            lo, hi = max(data - base, 0), min(volume.sectors - base, 32)
            words.append(((1 << (hi - lo)) - 1) << (32 - hi) if lo < hi else 0)
        bits.append(put(numbered(b"BM", i, words)))
    maps = [put(numbered(b"MI", i, bits[i * PER_INDEX : (i + 1) * PER_INDEX])) for i in range(n_maps)]
    ext = bytearray(RESERVED)
    struct.pack_into(">2sHIII", ext, 0, b"EX", 0, 0, 1, 19 << 16 | 2)
    struct.pack_into(">H", ext, 56, MAX_NAME + 1)
    extension = put(ext)
    used = (following - ROOT_AT - cluster) // 2 + cluster // 2
    root = bytearray(cluster * SECTOR)
    struct.pack_into(">III", root, 0, DISK, HARD_DISK | SPLIT | EXTENSIONS | SIZES | EXTENSION_BLOCK | STAMPED, 1)
    put_bstr(root, 0x14, volume.name, 32)
    total = n_reserved + cluster // 2
    struct.pack_into(">IIIHHIIIIII", root, 0x34, last, first, total - used, RESERVED, cluster, volume.sectors - data, (volume.sectors - last) // 20, 0, 0, volume.sectors, extension)
    struct.pack_into(f">{SMALL_BITMAPS}I", root, 0x60, *maps, *[0] * (SMALL_BITMAPS - n_maps))
    struct.pack_into(f">{n_indexes}I", root, 0x60 + 4 * SMALL_BITMAPS, *indexes)
    struct.pack_into(">2sHII", root, SECTOR, b"BM", 0, 1, 0)
    for w in range(total // 32 + 1):
        lo, hi = max(used - 32 * w, 0), min(total - 32 * w, 32)
        struct.pack_into(">I", root, SECTOR + 12 + 4 * w, ((1 << (hi - lo)) - 1) << (32 - hi) if lo < hi else 0)
    out[ROOT_AT * SECTOR : ROOT_AT * SECTOR + len(root)] = root
    struct.pack_into(">I", out, 0, DISK)
    return bytes(out)
