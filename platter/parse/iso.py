"""ISO 9660 images, with Joliet names where there are any."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

SECTOR = 2048


@dataclass
class Entry:
    path: str
    is_dir: bool
    extent: int
    size: int
    modified: datetime | None


def recorded(raw: bytes) -> datetime | None:
    """Seven bytes: years since 1900 to seconds, and quarter hours east of Greenwich."""
    y, mo, d, h, mi, s = raw[:6]
    (zone,) = struct.unpack_from("b", raw, 6)
    if not y:
        return None
    try:
        return (datetime(1900 + y, mo, d, h, mi, s) - timedelta(minutes=15 * zone)).replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def name_of(raw: bytes, joliet: bool) -> str:
    text = raw.decode("utf-16-be", "replace") if joliet else re.sub(r"[^\x20-\x7e]", "_", raw.decode("latin-1"))
    return re.sub(r"\.$", "", re.sub(r";[^;]*$", "", text))


def read(raw: bytes) -> tuple[str, list[Entry]]:
    """The volume's name and all entries, parents first."""
    root, joliet, name = None, False, ""
    for n in range(16, 64):
        d = raw[n * SECTOR : (n + 1) * SECTOR]
        if d[1:6] != b"CD001" or d[0] == 255:
            break
        supplement = d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E")
        if (d[0] == 1 and root is None) or supplement:
            root, joliet = d[156:190], supplement
            name = d[40:72].decode("utf-16-be" if supplement else "latin-1", "replace").strip()
    if root is None:
        raise ValueError("no volume descriptor")
    out, todo = [], [("", struct.unpack_from("<I", root, 2)[0], struct.unpack_from("<I", root, 10)[0])]
    seen = {todo[0][1]}
    while todo:
        parent, extent, size = todo.pop(0)
        data, at = raw[extent * SECTOR : extent * SECTOR + size], 0
        while at < len(data):
            n = data[at]
            if not n:
                at = (at // SECTOR + 1) * SECTOR
                continue
            r = data[at : at + n]
            at += n
            ident = r[33 : 33 + r[32]]
            if ident in (b"\0", b"\1"):
                continue
            if r[25] & 0x80:
                raise ValueError("files of several extents are not supported")
            where, length = struct.unpack_from("<I", r, 2)[0], struct.unpack_from("<I", r, 10)[0]
            e = Entry(f"{parent}/{name_of(ident, joliet)}".lstrip("/"), bool(r[25] & 2), where, length, recorded(r[18:25]))
            out.append(e)
            if e.is_dir and where not in seen:
                seen.add(where)
                todo.append((e.path, where, length))
    return name, out


def content(raw: bytes, e: Entry) -> bytes:
    return raw[e.extent * SECTOR : e.extent * SECTOR + e.size]
