"""IFF files, run-length bodies and planar pictures."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np


def chunks(raw: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """The kind of a FORM and its chunks in order; a cut file gives what is there."""
    if raw[:4] != b"FORM":
        raise ValueError("no FORM")
    end = min(len(raw), 8 + struct.unpack_from(">I", raw, 4)[0])
    at, out = 12, []
    while at + 8 <= end:
        (n,) = struct.unpack_from(">I", raw, at + 4)
        out.append((raw[at : at + 4].decode("latin-1"), raw[at + 8 : min(at + 8 + n, end)]))
        at += 8 + n + n % 2
    return raw[8:12].decode("latin-1"), out


def form(kind: str, parts: list[tuple[str, bytes]]) -> bytes:
    body = kind.encode() + b"".join(name.encode() + struct.pack(">I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in parts)
    return b"FORM" + struct.pack(">I", len(body)) + body


def replaced(raw: bytes, name: str, data: bytes, which: int = 0) -> bytes:
    """The FORM with the content of one of its chunks of a name replaced; sizes and padding follow."""
    kind, parts = chunks(raw)
    places = [i for i, (n, _) in enumerate(parts) if n == name]
    if which >= len(places):
        raise ValueError(f"no chunk {name} of number {which}")
    parts[places[which]] = (name, data)
    return form(kind, parts)


def unpack_runs(raw: bytes, size: int) -> bytes:
    """ByteRun1: n up to 127 copies n + 1 bytes, above 128 repeats one 257 - n times, 128 is nothing."""
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < size:
        n = raw[i]
        i += 1
        if n < 128:
            out += raw[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += raw[i : i + 1] * (257 - n)
            i += 1
    return bytes(out[:size])


def pack_runs(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = 1
        while i + n < len(raw) and n < 128 and raw[i + n] == raw[i]:
            n += 1
        if n > 2:
            out += bytes([257 - n, raw[i]])
            i += n
            continue
        j = i
        while j < len(raw) and j - i < 128 and not (j + 2 < len(raw) and raw[j] == raw[j + 1] == raw[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + raw[i:j]
        i = j
    return bytes(out)


@dataclass
class Picture:
    width: int
    height: int
    rgba: np.ndarray  # height x width x 4


def ilbm(raw: bytes) -> Picture:
    """Planar pictures to RGBA: palettes, half-brite, hold-and-modify of 6 and 8 planes, a mask plane, a transparent colour. Rows
    that a cut body lacks are empty."""
    kind, parts = chunks(raw)
    found = dict(reversed(parts))
    if kind not in ("ILBM", "PBM ") or "BMHD" not in found:
        raise ValueError("no picture")
    w, h, _, _, depth, masking, packed, _, clear = struct.unpack_from(">HHhhBBBBH", found["BMHD"])
    mode = struct.unpack(">I", found["CAMG"][:4])[0] if len(found.get("CAMG", b"")) >= 4 else 0
    colours = np.frombuffer(found.get("CMAP", b"")[: len(found.get("CMAP", b"")) // 3 * 3], np.uint8).reshape(-1, 3)
    stride = (w + 15) // 16 * 2
    planes = depth + (masking == 1)
    size = stride * planes * h if kind == "ILBM" else (w + w % 2) * h
    body = unpack_runs(found.get("BODY", b""), size) if packed else found.get("BODY", b"")[:size]
    rows = len(body) // (stride * planes) if kind == "ILBM" else len(body) // (w + w % 2)
    out = np.zeros((h, w, 4), np.uint8)
    if kind == "PBM ":
        index = np.frombuffer(body, np.uint8)[: rows * (w + w % 2)].reshape(rows, -1)[:, :w].astype(np.int64)
        mask = np.ones((rows, w), bool)
    else:
        bits = np.unpackbits(np.frombuffer(body, np.uint8)[: rows * stride * planes].reshape(rows, planes, stride), axis=2)[:, :, :w]
        index = sum(bits[:, p].astype(np.int64) << p for p in range(depth)) if depth else np.zeros((rows, w), np.int64)
        mask = bits[:, depth].astype(bool) if masking == 1 else np.ones((rows, w), bool)
    if masking == 2:
        mask &= index != clear
    table = np.zeros((max(256, len(colours)), 3), np.uint8)
    table[: len(colours)] = colours
    if mode & 0x800 and depth >= 5:
        keep = depth - 2
        op, value = index >> keep, index & ((1 << keep) - 1)
        level = (value << (8 - keep) | value >> max(0, 2 * keep - 8)).astype(np.uint8)
        rgb = np.zeros((rows, w, 3), np.uint8)
        now = np.tile(table[0], (rows, 1))
        for x in range(w):
            o = op[:, x]
            now = np.where((o == 0)[:, None], table[value[:, x]], now)
            for code, channel in ((1, 2), (2, 0), (3, 1)):
                now[:, channel] = np.where(o == code, level[:, x], now[:, channel])
            rgb[:, x] = now
    else:
        if mode & 0x80 and depth == 6:
            table[32:64] = table[:32] >> 1
        rgb = table[index]
    out[:rows, :, :3] = rgb
    out[:rows, :, 3] = np.where(mask, 255, 0)
    return Picture(w, h, out)
