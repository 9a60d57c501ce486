"""Bit input and output, and canonical prefix codes."""

from __future__ import annotations

import heapq

import numpy as np


class BitReader:
    """Most significant bit first. Past the end come zeros, as far as a decoder may look ahead."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.n = raw, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.raw[self.at : self.at + 8]
            self.at += 8
            if self.at > len(self.raw) + 64:
                raise ValueError("the data ends too early")
            self.held = self.held << 64 | int.from_bytes(chunk.ljust(8, b"\0"), "big")
            self.n += 64

    def peek(self, n: int) -> int:
        self.fill(n)
        return self.held >> (self.n - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek(n)
        self.skip(n)
        return out


class BitWriter:
    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.held, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.held = self.held << n | value
        self.n += n
        if self.n >= 512:
            rest = self.n % 8
            self.parts.append((self.held >> rest).to_bytes(self.n // 8, "big"))
            self.held &= (1 << rest) - 1
            self.n = rest

    def done(self) -> bytes:
        pad = -self.n % 8
        return b"".join([*self.parts, (self.held << pad).to_bytes((self.n + pad) // 8, "big")])


def joined(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The bits of numbers of 0 to 62 bits each, one after the other, the most significant first."""
    ends = np.cumsum(widths)
    owner = np.repeat(np.arange(len(widths), dtype=np.int32), widths)
    shift = ends[owner] - 1 - np.arange(len(owner))
    return (values[owner] >> shift & 1).astype(np.uint8)


def lengths(counts: list[int], most: int = 16) -> list[int]:
    """Code lengths of a Huffman code, none above `most`: counts are flattened until the tree is flat enough."""
    counts = list(counts)
    while True:
        heap = [(c, i) for i, c in enumerate(counts) if c]
        out = [0] * len(counts)
        if len(heap) < 2:
            for _, i in heap:
                out[i] = 1
            return out
        used = [i for _, i in heap]
        heapq.heapify(heap)
        first = tag = len(counts)
        parent: dict[int, int] = {}
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = tag
            heapq.heapreplace(heap, (a[0] + b[0], tag))
            tag += 1
        depth = {tag - 1: 0}
        for i in range(tag - 2, first - 1, -1):
            depth[i] = depth[parent[i]] + 1
        for i in used:
            out[i] = depth[parent[i]] + 1
        if max(out) <= most:
            return out
        counts = [(c + 1) // 2 if c else 0 for c in counts]


def codes(sizes: list[int]) -> list[int]:
    """Canonical codes: by length, then by symbol."""
    out, code, last = [0] * len(sizes), 0, 0
    for s, i in sorted((s, i) for i, s in enumerate(sizes) if s):
        code <<= s - last
        out[i], last = code, s
        code += 1
    return out


class PrefixCode:
    """A canonical code as a look-up table of its longest length: each entry is symbol and length."""

    def __init__(self, sizes: list[int], only: int | None = None):
        self.only = only
        if only is None:
            self.width = max(sizes, default=0) or 1
            self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.width)
            for i, (c, n) in enumerate(zip(codes(sizes), sizes, strict=True)):
                if n:
                    lo = c << (self.width - n)
                    self.table[lo : lo + (1 << (self.width - n))] = [(i, n)] * (1 << (self.width - n))

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table[bits.peek(self.width)]
        if not n:
            raise ValueError("no such code")
        bits.skip(n)
        return symbol
