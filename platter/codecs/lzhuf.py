"""The LHA method lh1: matches in a ring of 4 KB, symbols in an adaptive Huffman tree."""

from __future__ import annotations

from .bits import BitReader, BitWriter, codes
from .lzh import greedy

N_SYMBOLS, LONGEST, WINDOW, MOST = 314, 60, 4096, 0x8000
#: How many codes of the upper six bits of a place have each length from 3 to 8; fixed values.
PLACES = ((3, 1), (4, 3), (5, 8), (6, 12), (7, 24), (8, 16))
_SIZES = [n for n, k in PLACES for _ in range(k)]
_CODES = codes(_SIZES)
_TABLE = [(0, 0)] * 256
for _i, (_c, _n) in enumerate(zip(_CODES, _SIZES, strict=True)):
    for _k in range(1 << (8 - _n)):
        _TABLE[_c << (8 - _n) | _k] = (_i, _n)


class Tree:
    """Weights in ascending order of nodes; after each symbol the path to the root is counted up and kept in order."""

    def __init__(self) -> None:
        n, top = N_SYMBOLS, 2 * N_SYMBOLS - 2
        self.top = top
        self.weight = [1] * n + [0] * (n - 1) + [0xFFFF]
        self.child = [i + top + 1 for i in range(n)] + [0] * (n - 1)  # a leaf: top + 1 + symbol; a node: its first child
        self.parent = [0] * (top + 1 + n)
        for i in range(n):
            self.parent[i + top + 1] = i
        i = 0
        for j in range(n, top + 1):
            self.weight[j] = self.weight[i] + self.weight[i + 1]
            self.child[j] = i
            self.parent[i] = self.parent[i + 1] = j
            i += 2
        self.parent[top] = 0

    def _rebuild(self) -> None:
        n, top = N_SYMBOLS, self.top
        leaves = [((w + 1) // 2, c) for w, c in zip(self.weight[: top + 1], self.child, strict=False) if c > top]
        for i, (w, c) in enumerate(leaves):
            self.weight[i], self.child[i] = w, c
        i, end = 0, n
        for j in range(n, top + 1):
            w = self.weight[i] + self.weight[i + 1]
            at = end
            while self.weight[at - 1] > w:
                at -= 1
            self.weight[at + 1 : end + 1] = self.weight[at:end]
            self.child[at + 1 : end + 1] = self.child[at:end]
            self.weight[at], self.child[at] = w, i
            end += 1
            i += 2
        for i in range(top + 1):
            c = self.child[i]
            self.parent[c] = i
            if c <= top:
                self.parent[c + 1] = i

    def count(self, symbol: int) -> None:
        top = self.top
        if self.weight[top] == MOST:
            self._rebuild()
        node = self.parent[symbol + top + 1]
        while True:
            self.weight[node] += 1
            w = self.weight[node]
            if w > self.weight[node + 1]:
                last = node + 1
                while w > self.weight[last + 1]:
                    last += 1
                self.weight[node], self.weight[last] = self.weight[last], w
                a, b = self.child[node], self.child[last]
                self.parent[a] = last
                if a <= top:
                    self.parent[a + 1] = last
                self.parent[b] = node
                if b <= top:
                    self.parent[b + 1] = node
                self.child[node], self.child[last] = b, a
                node = last
            if node == top:
                return
            node = self.parent[node]

    def read(self, bits: BitReader) -> int:
        c = self.child[self.top]
        while c <= self.top:
            c = self.child[c + bits.take(1)]
        self.count(c - self.top - 1)
        return c - self.top - 1

    def write(self, bits: BitWriter, symbol: int) -> None:
        node, path = self.parent[symbol + self.top + 1], []
        while node != self.top:
            path.append(node & 1)
            node = self.parent[node]
        for b in reversed(path):
            bits.put(b, 1)
        self.count(symbol)


def expand(raw: bytes, size: int) -> bytes:
    bits, tree, out = BitReader(raw), Tree(), bytearray(b" " * WINDOW)
    end = WINDOW + size
    while len(out) < end:
        c = tree.read(bits)
        if c < 256:
            out.append(c)
            continue
        high, n = _TABLE[bits.peek(8)]
        bits.skip(n)
        back = (high << 6 | bits.take(6)) + 1
        for _ in range(c - 256 + 3):
            out.append(out[-back])
    return bytes(out[WINDOW:end])


def pack(raw: bytes) -> bytes:
    bits, tree = BitWriter(), Tree()
    for a, back in greedy(raw, WINDOW - LONGEST, LONGEST):
        if not back:
            tree.write(bits, a)
            continue
        tree.write(bits, a - 3 + 256)
        high = (back - 1) >> 6
        bits.put(_CODES[high], _SIZES[high])
        bits.put((back - 1) & 63, 6)
    return bits.done()
