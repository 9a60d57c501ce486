"""FAT32 volumes: read into entries, written whole from entries."""

from __future__ import annotations

import struct
import unicodedata
from dataclasses import dataclass, field

MASK, LAST = 0x0FFFFFFF, 0x0FFFFFF8
READ_ONLY, HIDDEN, SYSTEM, LABEL, FOLDER, ARCHIVE, LONG = 1, 2, 4, 8, 16, 32, 15
_SHORT_MARKS = "!#$%&'()-@^_`{}~"


@dataclass
class Layout:
    sector: int
    per_cluster: int
    reserved: int
    fats: int
    fat_sectors: int
    root: int
    sectors: int

    @property
    def data(self) -> int:
        return self.reserved + self.fats * self.fat_sectors

    @property
    def clusters(self) -> int:
        """As many as there is room for and as the table has entries: the size of the table may be an entry short."""
        return min((self.sectors - self.data) // self.per_cluster, self.fat_sectors * self.sector // 4 - 2)

    @property
    def cluster_bytes(self) -> int:
        return self.sector * self.per_cluster

    def offset(self, cluster: int) -> int:
        return (self.data + (cluster - 2) * self.per_cluster) * self.sector


def layout(raw: bytes) -> Layout:
    """The parameters of a boot sector that is one of FAT32."""
    if len(raw) < 512 or raw[510:512] != b"\x55\xaa":
        raise ValueError("no boot sector")
    sector, per, reserved, fats, roots, small = struct.unpack_from("<HBHBHH", raw, 11)
    (fat16,) = struct.unpack_from("<H", raw, 22)
    sectors, fat32 = struct.unpack_from("<II", raw, 32)
    (root,) = struct.unpack_from("<I", raw, 44)
    if roots or small or fat16 or not fat32 or sector not in (512, 1024, 2048, 4096) or not per or per & per - 1 or fats not in (1, 2):
        raise ValueError("not FAT32")
    return Layout(sector, per, reserved, fats, fat32, root, sectors)


@dataclass
class Entry:
    path: str
    is_dir: bool
    content: bytes = b""
    stamp: int = 0x21 << 16
    attributes: int = ARCHIVE
    size: int = 0
    note: str | None = None


@dataclass
class Volume:
    label: str
    layout: Layout
    entries: list[Entry] = field(default_factory=list)
    free: int = 0


def short_checksum(raw: bytes) -> int:
    s = 0
    for c in raw:
        s = ((s & 1) << 7) + (s >> 1) + c & 255
    return s


def short(name: str) -> bytes:
    """The 11 bytes of a short name: capitals, digits and some marks, cut, with no counter."""
    base, dot, ext = name.rpartition(".")
    if not dot or not base:
        base, ext = name, ""
    allowed = lambda c: unicodedata.category(c) in ("Lu", "Lt", "Nd") or c in _SHORT_MARKS
    part = lambda x, n: "".join(filter(allowed, x.upper()))[:n].ljust(n).encode("latin-1", "replace")
    return part(base, 8) + part(ext, 3)


def shown(raw: bytes) -> str:
    base, ext = raw[:8].decode("latin-1").rstrip(), raw[8:11].decode("latin-1").rstrip()
    return f"{base}.{ext}" if ext else base


def records(raw: bytes) -> list[tuple[str, int, int, int, int]]:
    """(name, attributes, cluster, size, stamp) of a directory's bytes, long names put together by their numbers."""
    out, pending = [], []
    for at in range(0, len(raw) - 31, 32):
        r = raw[at : at + 32]
        if r[0] == 0:
            break
        if r[0] == 0xE5:
            pending = []
            continue
        if r[11] & 0x3F == LONG:
            pending.append((r[0] & 0x3F, r[1:11] + r[14:26] + r[28:32]))
            continue
        if r[11] & LABEL:
            pending = []
            continue
        name = shown(r[:11])
        if pending:
            units = struct.unpack(f"<{13 * len(pending)}H", b"".join(x for _, x in sorted(pending)))
            end = next((i for i, u in enumerate(units) if u in (0, 0xFFFF)), len(units))
            name = "".join(chr(u) for u in units[:end] if not 0xD800 <= u <= 0xDFFF)
        pending = []
        hi, time, date, lo, size = struct.unpack_from("<HHHHI", r, 20)
        out.append((name, r[11], hi << 16 | lo, size, date << 16 | time))
    return out


def read(raw: bytes) -> Volume:
    """All entries that the root reaches, parents first; chains that leave the table or go round are cut and noted."""
    p = layout(raw)
    table = struct.unpack_from(f"<{p.clusters + 2}I", raw, p.reserved * p.sector)

    def chain(c: int) -> tuple[bytes, bool]:
        parts: list[bytes] = []
        while 2 <= c < p.clusters + 2 and len(parts) <= p.clusters:
            parts.append(raw[p.offset(c) : p.offset(c) + p.cluster_bytes])
            c = table[c] & MASK
        return b"".join(parts), c >= LAST or not parts

    out = Volume(raw[71:82].decode("latin-1").rstrip(), p, free=sum(1 for x in table[2:] if x & MASK == 0))
    todo, seen = [("", p.root)], {p.root}
    while todo:
        parent, cluster = todo.pop(0)
        for name, attributes, first, size, stamp in records(chain(cluster)[0]):
            if name in (".", ".."):
                continue
            e = Entry(f"{parent}/{name}".lstrip("/"), bool(attributes & FOLDER), b"", stamp, attributes, size)
            if e.is_dir and first not in seen:
                seen.add(first)
                todo.append((e.path, first))
            elif not e.is_dir:
                data, whole = chain(first) if size else (b"", True)
                e.content = data[:size]
                e.note = None if whole and len(e.content) == size else "cut"
            out.entries.append(e)
    return out


def _record(name: bytes, attributes: int, cluster: int, size: int, stamp: int) -> bytes:
    r = bytearray(32)
    r[:11] = name
    r[11] = attributes
    struct.pack_into("<HHHHI", r, 20, cluster >> 16, stamp & 0xFFFF, stamp >> 16, cluster & 0xFFFF, size)
    return bytes(r)


def named(name: str, attributes: int, cluster: int, size: int, stamp: int) -> bytes:
    """A record, behind those of its long name where the short one doesn't say it all."""
    key = short(name)
    out = b""
    if shown(key) != name:
        units = list(struct.unpack(f"<{len(name.encode('utf-16-le')) // 2}H", name.encode("utf-16-le")))
        units = units + [0] if len(units) % 13 else units
        units += [0xFFFF] * (-len(units) % 13)
        n = len(units) // 13
        for k in range(n, 0, -1):
            u = struct.pack("<13H", *units[13 * (k - 1) : 13 * k])
            out += bytes([k | (0x40 if k == n else 0)]) + u[:10] + bytes([LONG, 0, short_checksum(key)]) + u[10:22] + b"\0\0" + u[22:]
    return out + _record(key, attributes, cluster, size, stamp)


def write(volume: Volume) -> bytes:
    """The volume with all its entries: clusters are taken first-fit from 2, root first, parents before children."""
    p = volume.layout
    table = [0x0FFFFFF8, MASK] + [0] * p.clusters
    out = bytearray(p.sectors * p.sector)
    following = 2

    def put(data: bytes) -> int:
        nonlocal following
        n = max(1, -(-len(data) // p.cluster_bytes))
        first = following
        if first + n > p.clusters + 2:
            raise ValueError("the volume is full")
        for k in range(n):
            table[first + k] = first + k + 1 if k + 1 < n else MASK
        out[p.offset(first) : p.offset(first) + len(data)] = data
        following += n
        return first

    entries: dict[str, Entry] = {}
    for e in sorted(volume.entries, key=lambda e: (e.path.count("/"), e.path)):
        parts = [x for x in e.path.split("/") if x]
        for i in range(1, len(parts)):
            entries.setdefault("/".join(parts[:i]), Entry("/".join(parts[:i]), True))
        entries["/".join(parts)] = e
    children: dict[str, list[tuple[str, Entry]]] = {"": []}
    for path, e in entries.items():
        children.setdefault(path.rpartition("/")[0], []).append((path, e))
    # directories get their clusters first, as their sizes are known
    size_of = lambda d: sum(len(named(q.rpartition("/")[2], 0, 0, 0, 0)) for q, _ in children.get(d, ())) + (64 if d else 32)
    where = {"": put(bytes(size_of("")))}
    for path in [q for q, e in entries.items() if e.is_dir]:
        where[path] = put(bytes(size_of(path)))
    for d, at in where.items():
        rows = _record(volume.label.upper()[:11].ljust(11).encode("latin-1", "replace"), LABEL, 0, 0, 0x21 << 16) if not d else b""
        if d:
            up = d.rpartition("/")[0]
            rows = _record(b".".ljust(11), FOLDER, at, 0, 0x21 << 16) + _record(b"..".ljust(11), FOLDER, where[up] if up else 0, 0, 0x21 << 16)
        for path, e in children.get(d, ()):
            first = where[path] if e.is_dir else put(e.content) if e.content else 0
            rows += named(path.rpartition("/")[2], (e.attributes & ~ARCHIVE | FOLDER) if e.is_dir else e.attributes, first, len(e.content), e.stamp)
        out[p.offset(at) : p.offset(at) + len(rows)] = rows
    boot = bytearray(512)
    boot[:11] = b"\xeb\x58\x90MSWIN4.1"
    struct.pack_into("<HBHBHHBHHHII", boot, 11, p.sector, p.per_cluster, p.reserved, p.fats, 0, 0, 0xF8, 0, 63, 255, 0, p.sectors)
    struct.pack_into("<IHHIHH", boot, 36, p.fat_sectors, 0, 0, where[""], 1, 6)
    boot[64], boot[66] = 0x80, 0x29
    boot[71:82] = volume.label.upper()[:11].ljust(11).encode("latin-1", "replace")
    boot[82:90] = b"FAT32   "
    boot[510:512] = b"\x55\xaa"
    out[:512] = boot
    if p.reserved > 6:
        out[6 * p.sector : 6 * p.sector + 512] = boot
    if p.reserved > 1:
        struct.pack_into("<I", out, p.sector, 0x41615252)
        struct.pack_into("<III", out, p.sector + 484, 0x61417272, p.clusters + 2 - following, following)
        out[p.sector + 510 : p.sector + 512] = b"\x55\xaa"
    raw = struct.pack(f"<{len(table)}I", *table)
    for k in range(p.fats):
        at = (p.reserved + k * p.fat_sectors) * p.sector
        out[at : at + len(raw)] = raw
    return bytes(out)


def blank(sectors: int, label: str = "BOOT", per_cluster: int | None = None, reserved: int = 32, fats: int = 2) -> Volume:
    """An empty volume."""
    mb = sectors // 2048
    per = per_cluster or next((n for limit, n in ((512, 1), (8192, 8), (16384, 16), (32768, 32)) if mb <= limit), 64)
    return Volume(label, Layout(512, per, reserved, fats, 4 * (sectors - reserved) // (512 * per + 4 * fats) + 1, 2, sectors))
