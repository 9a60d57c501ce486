"""Preference files and libraries with a name changed inside them."""

from __future__ import annotations

import re
import struct

import numpy as np

from . import pictures

#: Bytes of a backdrop chunk before the length of its path; fixed by the format.
PATTERN_HEAD = 23
#: Block kinds of load files, and the word that marks a resident structure, with the place of its name pointer; fixed values.
HEADER, CODE, RELOCATIONS = 0x3F3, 0x3E9, 0x3EC
RESIDENT, NAME_AT = b"\x4a\xfc", 14


def _chunk(raw: bytes, name: str, least: int) -> bytes:
    kind, parts = pictures.chunks(raw)
    found = next((x for n, x in parts if n == name), None)
    if kind != "PREF" or found is None or len(found) < least:
        raise ValueError(f"no preferences with a whole chunk {name}")
    return found


def backdrop(raw: bytes, path: str) -> bytes:
    """The preferences with the path of the first backdrop replaced; flags and type stay. A path has up to 255 bytes."""
    text = path.encode("latin-1", "replace")
    if len(text) > 255:
        raise ValueError("path too long")
    head = _chunk(raw, "PTRN", PATTERN_HEAD + 1)[:PATTERN_HEAD]
    return pictures.replaced(raw, "PTRN", head + bytes([len(text)]) + text)


def keymap(raw: bytes, name: str) -> tuple[bytes, str]:
    """The input preferences with another keymap, and the name of the one before."""
    body = _chunk(raw, "INPT", 2)
    (n,) = struct.unpack_from(">H", body)
    text = name.encode()
    field = struct.pack(">H", len(text)) + text + b"\0" * (len(text) % 2)
    return pictures.replaced(raw, "INPT", field + body[2 + n + n % 2 :]), body[2 : 2 + n].decode("ascii", "replace")


class Library:
    """A load file whose first block is code: where the code lies, and the places in it that the loader adds its address to."""

    def __init__(self, raw: bytes):
        self.raw, self._at = raw, 0
        if self._next() != HEADER:
            raise ValueError("no load file")
        while names := self._next():
            self._at += 4 * names
        _, first, last = self._next(), self._next(), self._next()
        self.sizes = self._at
        self._at += 4 * (last - first + 1)
        if self._next() & 0x3FFFFFFF != CODE:
            raise ValueError("no code")
        longs = self._next() & 0x3FFFFFFF
        self.start, self.end = self._at, self._at + 4 * longs
        if self.end > len(raw):
            raise ValueError("code is cut")
        self.code = raw[self.start : self.end]
        self._at = self.end
        self.places = self._relocated()

    def _next(self) -> int:
        if self._at + 4 > len(self.raw):
            raise ValueError("load file is cut")
        self._at += 4
        return struct.unpack_from(">I", self.raw, self._at - 4)[0]

    def _relocated(self) -> np.ndarray:
        """Places in the code that point into the code itself; a cut list gives the whole groups that are there."""
        found = [np.zeros(0, np.int64)]
        if self.raw[self.end : self.end + 4] == struct.pack(">I", RELOCATIONS):
            self._at = self.end + 4
            while self._at + 8 <= len(self.raw) and (n := self._next()):
                block = self._next()
                if self._at + 4 * n > len(self.raw):
                    break
                if block == 0:
                    found.append(np.frombuffer(self.raw, ">u4", n, self._at).astype(np.int64))
                self._at += 4 * n
        places = np.concatenate(found)
        return places[places + 4 <= len(self.code)]

    @property
    def pointer(self) -> int:
        """The place of the pointer to the library's name."""
        mark = next((m.start() for m in re.finditer(re.escape(RESIDENT), self.code) if m.start() % 2 == 0), None)
        if mark is None or mark + NAME_AT + 4 > len(self.code):
            raise ValueError("no resident structure")
        return mark + NAME_AT

    @property
    def name(self) -> str:
        (at,) = struct.unpack_from(">I", self.code, self.pointer)
        if at >= len(self.code):
            raise ValueError("the name lies outside the code")
        return self.code[at:].split(b"\0")[0].decode("latin-1")

    def renamed(self, name: str, header: bool = False) -> bytes:
        """The file with another name behind its code, to which all pointers to the old one lead. header: the table of sizes in the
        file's header grows too, which loaders that allocate by it need; without, only the block's own size does."""
        _ = self.name  # there must be one
        text = name.encode() + b"\0"
        text += b"\0" * (-len(text) % 4)
        code = bytearray(self.code)
        old = code[self.pointer : self.pointer + 4]
        same = [p for p in self.places.tolist() if code[p : p + 4] == old]
        for p in same or [self.pointer]:
            struct.pack_into(">I", code, p, len(self.code))
        front = bytearray(self.raw[: self.start])
        for at in (self.start - 4, *([self.sizes] if header else [])):
            struct.pack_into(">I", front, at, struct.unpack_from(">I", front, at)[0] + len(text) // 4)
        return bytes(front + code) + text + self.raw[self.end :]
