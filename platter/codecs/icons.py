"""Workbench icons: metadata, tool types, stack and default tool, read and changed."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field, replace

import numpy as np

from . import pictures

MAGIC, HEAD, DRAWER, IMAGE = 0xE310, 78, 56, 20
NO_POSITION = -0x80000000
KINDS = {1: "disk", 2: "drawer", 3: "tool", 4: "project", 5: "garbage", 6: "device", 7: "kick", 8: "appicon"}
MOST_TOOL_TYPES = 256


@dataclass
class Icon:
    kind: int
    stack: int = 4096
    x: int | None = None
    y: int | None = None
    default_tool: str | None = None
    tool_types: list[str] | None = None
    drawer: bytes | None = None
    images: list[tuple[int, int, int, bytes]] = field(default_factory=list)  # width, height, depth, planes
    head: bytes = b""
    rest: bytes = b""

    @property
    def kind_name(self) -> str:
        return KINDS.get(self.kind, "unknown")


def _text(raw: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from(">I", raw, at)
    return raw[at + 4 : at + 4 + n].split(b"\0")[0].decode("latin-1"), at + 4 + n


def read(raw: bytes) -> Icon:
    if len(raw) < HEAD or struct.unpack_from(">H", raw)[0] != MAGIC:
        raise ValueError("no icon")
    kind, tool, types, x, y, drawer = struct.unpack_from(">BxIIiiI", raw, 48)
    (stack,) = struct.unpack_from(">I", raw, 74)
    out = Icon(kind, stack, None if x == NO_POSITION else x, None if y == NO_POSITION else y, head=raw[:HEAD])
    at = HEAD
    if drawer:
        out.drawer = raw[at : at + DRAWER]
        at += DRAWER
    for pointer in struct.unpack_from(">II", raw, 22):
        if pointer:
            _, _, w, h, depth, data = struct.unpack_from(">hhhhhI", raw, at)
            size = (w + 15) // 16 * 2 * h * depth if data else 0
            out.images.append((w, h, depth, raw[at : at + IMAGE + size]))
            at += IMAGE + size
    if tool:
        out.default_tool, at = _text(raw, at)
    if types:
        n = struct.unpack_from(">I", raw, at)[0] // 4 - 1
        at += 4
        out.tool_types = []
        for _ in range(min(n, MOST_TOOL_TYPES)):
            text, at = _text(raw, at)
            out.tool_types.append(text)
    out.rest = raw[at:]
    return out


def write(icon: Icon) -> bytes:
    """The icon again; what was not changed keeps its bytes."""
    head = bytearray(icon.head.ljust(HEAD, b"\0"))
    pointer = lambda there: 1 if there else 0
    struct.pack_into(">HH", head, 0, MAGIC, 1)
    for i, at in enumerate((22, 26)):
        if bool(struct.unpack_from(">I", head, at)[0]) != (len(icon.images) > i):
            struct.pack_into(">I", head, at, pointer(len(icon.images) > i))
    old = struct.unpack_from(">IIiiI", head, 50)
    keep = lambda value, there: value if bool(value) == there else pointer(there)
    struct.pack_into(">BxIIiiI", head, 48, icon.kind, keep(old[0], icon.default_tool is not None), keep(old[1], icon.tool_types is not None), NO_POSITION if icon.x is None else icon.x, NO_POSITION if icon.y is None else icon.y, keep(old[4], icon.drawer is not None))
    struct.pack_into(">I", head, 74, icon.stack)
    text = lambda s: struct.pack(">I", len(s) + 1) + s.encode("latin-1", "replace") + b"\0"
    out = bytes(head) + (icon.drawer or b"") + b"".join(x[3] for x in icon.images)
    if icon.default_tool is not None:
        out += text(icon.default_tool)
    if icon.tool_types is not None:
        out += struct.pack(">I", 4 * (len(icon.tool_types) + 1)) + b"".join(map(text, icon.tool_types))
    return out + icon.rest


def changed(raw: bytes, **fields: object) -> bytes:
    """The icon with some of its fields replaced: stack, default_tool, tool_types, kind, x, y."""
    return write(replace(read(raw), **fields))  # type: ignore[arg-type]


#: Colours of the eight pens of old icons; fixed values.
PENS = ((149, 149, 149), (0, 0, 0), (255, 255, 255), (59, 103, 162), (123, 123, 123), (175, 175, 175), (170, 144, 124), (255, 169, 151))


def picture(icon: Icon, which: int = 0) -> np.ndarray:
    """An image of the icon as height x width x 4; pen 0 is transparent."""
    w, h, depth, raw = icon.images[which]
    stride = (w + 15) // 16 * 2
    planes = np.frombuffer(raw[IMAGE : IMAGE + stride * h * depth], np.uint8).reshape(depth, h, stride)
    pen = sum(np.unpackbits(planes[p], axis=1)[:, :w].astype(np.int64) << p for p in range(depth)) if depth else np.zeros((h, w), np.int64)
    rgb = np.array(PENS, np.uint8)[pen % len(PENS)]
    return np.dstack([rgb, np.where(pen > 0, 255, 0).astype(np.uint8)])


#: Flags of a colour image, and the largest one that is read.
CLEAR, PALETTE, MOST_SIDE = 1, 2, 1024


def _items(raw: bytes, width: int, count: int, packed: bool) -> np.ndarray:
    """Up to count numbers of width bits each from a stream of bits; packed: as runs behind bytes that count as in ByteRun1."""
    if not packed:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        n = max(0, min(count, len(bits) // width))
        return bits[: n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1))
    end, raw, out, at = 8 * len(raw), raw + b"\0", [], 0

    def one(at: int, width: int) -> int:
        k = at >> 3
        return (raw[k] << 8 | raw[k + 1]) >> (16 - (at & 7) - width) & ((1 << width) - 1)

    while len(out) < count and at + 8 <= end:
        n = one(at, 8)
        at += 8
        if n < 128:
            out += [one(k, width) for k in range(at, min(at + width * (n + 1), end - width + 1), width)]
            at += width * (n + 1)
        elif n > 128:
            if at + width <= end:
                out += [one(at, width)] * (257 - n)
            at += width
    return np.array(out[:count], np.int64)


def colour_picture(raw: bytes) -> np.ndarray | None:
    """The first image of the colour icon behind a plain one, as height x width x 4; None where there is none to read."""
    form = re.search(rb"FORM.{4}ICON", raw[HEAD:], re.DOTALL)
    if form is None:
        return None
    parts = dict(reversed(pictures.chunks(raw[HEAD + form.start() :])[1]))  # of each name the first
    face, image = parts.get("FACE", b""), parts.get("IMAG", b"")
    if len(face) < 6 or len(image) < 10:
        return None
    w, h = face[0] + 1, face[1] + 1
    clear, colours, flags, packed, packed_palette, depth, size, palette_size = struct.unpack_from(">6BHH", image)
    if not 1 <= depth <= 8 or not flags & PALETTE or max(w, h) > MOST_SIDE or 10 + size + 1 > len(image):
        return None
    pen = _items(image[10 : 11 + size], depth, w * h, packed != 0)
    rgb = _items(image[11 + size : 12 + size + palette_size], 8, 3 * (colours + 1), packed_palette != 0)
    rgb = rgb[: len(rgb) // 3 * 3].reshape(-1, 3)
    if len(pen) < w * h or not len(rgb):
        return None
    known = np.zeros((256, 3), np.uint8)  # pens without a colour are black
    known[: len(rgb)] = rgb
    alpha = np.where((pen == clear) & bool(flags & CLEAR), 0, 255).astype(np.uint8)
    return np.dstack([known[pen].reshape(h, w, 3), alpha.reshape(h, w)])


def colour_form(pens: np.ndarray, colours: np.ndarray, clear: int | None, packed: bool) -> bytes:
    """The form of a colour icon with one image: pens (height x width, below 256) and their colours (n x 3). packed: pens and
    colours are written as runs of up to 128 equal items; else plainly."""

    def stream(items: np.ndarray, width: int) -> bytes:
        bits = lambda x, n: (x[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8)
        if not packed:
            return np.packbits(bits(items, width).ravel()).tobytes()
        head = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
        long = np.diff(np.append(head, len(items)))
        times = (long - 1) // 128 + 1
        n = np.full(int(times.sum()), 128)
        n[np.cumsum(times) - 1] = (long - 1) % 128 + 1
        item = np.repeat(items[head], times)
        return np.packbits(np.hstack([bits(np.where(n > 1, 257 - n, 0), 8), bits(item, width)]).ravel()).tobytes()

    h, w = pens.shape
    depth = max(1, int(len(colours) - 1).bit_length())
    body, palette = stream(pens.ravel().astype(np.int64), depth), stream(colours.ravel().astype(np.int64), 8)
    head = struct.pack(">6BHH", clear or 0, len(colours) - 1, PALETTE | (CLEAR if clear is not None else 0), packed, packed, depth, len(body) - 1, len(palette) - 1)
    return pictures.form("ICON", [("FACE", struct.pack(">4BH", w - 1, h - 1, 0, 0, 3 * len(colours) - 1)), ("IMAG", head + body + palette)])
