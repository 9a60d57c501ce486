"""LHA: members, the lh4 to lh7 family, LArc's two methods, and archives."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from platter.functions.checksums import crc16_of

from .bits import BitReader, PrefixCode, codes, joined, lengths

#: Bits of the dictionary and of the count of distance codes, by method: fixed values of the format.
METHODS = {"-lh4-": (12, 4), "-lh5-": (13, 4), "-lh6-": (15, 5), "-lh7-": (16, 5)}
STORED = ("-lh0-", "-lz4-", "-pm0-")
LITERALS, SHORTEST, LONGEST = 256, 3, 256
N_SYMBOLS = LITERALS + LONGEST - SHORTEST + 1
BLOCK = 16_000


def _small_code(bits: BitReader, width: int, gap: int | None) -> PrefixCode:
    n = bits.take(width)
    if n == 0:
        return PrefixCode([], bits.take(width))
    sizes: list[int] = []
    while len(sizes) < n:
        k = bits.take(3)
        if k == 7:
            while bits.take(1):
                k += 1
        sizes.append(k)
        if len(sizes) == gap:
            sizes += [0] * bits.take(2)
    return PrefixCode(sizes)


def _symbol_code(bits: BitReader, small: PrefixCode) -> PrefixCode:
    n = bits.take(9)
    if n == 0:
        return PrefixCode([], bits.take(9))
    sizes: list[int] = []
    while len(sizes) < n:
        c = small.read(bits)
        if c > 2:
            sizes.append(c - 2)
        else:
            sizes += [0] * (1 if c == 0 else bits.take(4) + 3 if c == 1 else bits.take(9) + 20)
    return PrefixCode(sizes[:n])


def expand(raw: bytes, size: int, method: str = "-lh5-") -> bytes:
    """Decodes lh4 to lh7. Before the data the dictionary is all spaces."""
    window, width = METHODS[method]
    bits, out = BitReader(raw), bytearray(b" " * (1 << window))
    start = len(out)
    end = start + size
    while len(out) < end:
        left = bits.take(16)
        small = _small_code(bits, 5, 3)
        symbols = _symbol_code(bits, small)
        _tokens(bits, out, end, left or 1 << 16, symbols, _small_code(bits, width, None))
    return bytes(out[start:end])


def _tokens(bits: BitReader, out: bytearray, end: int, left: int, symbols: PrefixCode, places: PrefixCode) -> None:
    """Up to `left` literals and copies of one block; the reader's bits are held in local names."""
    table, w, only = (symbols.table, symbols.width, None) if symbols.only is None else ([], 0, symbols.only)
    far, v, lone = (places.table, places.width, None) if places.only is None else ([], 0, places.only)
    held, n, done = bits.held, bits.n, len(out)
    for _ in range(left):
        if done >= end:
            break
        if n < 48:
            bits.held, bits.n = held, n
            bits.fill(48)
            held, n = bits.held, bits.n
        c = only
        if c is None:
            c, k = table[held >> (n - w)]
            if not k:
                raise ValueError("no such code")
            n -= k
            held &= (1 << n) - 1
        if c < LITERALS:
            out.append(c)
            done += 1
            continue
        p = lone
        if p is None:
            p, k = far[held >> (n - v)]
            if not k:
                raise ValueError("no such code")
            n -= k
            held &= (1 << n) - 1
        back = 1
        if p:
            n -= p - 1
            back += (1 << (p - 1)) + (held >> n)
            held &= (1 << n) - 1
        c += SHORTEST - LITERALS
        at = done - back
        if back >= c:
            out += out[at : at + c]
        else:
            piece = bytes(out[at:])
            out += (piece * (c // back + 1))[:c]
        done += c
    bits.held, bits.n = held, n


#: Bytes and contents whose matches are looked for side by side.
SIDE, SIDE_CONTENTS = 1 << 20, 1 << 12


def _same(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from i and j on are the same, up to most; words: the eight bytes from each place on. The first three are known to be."""
    n = np.full(len(i), SHORTEST, np.int32)
    left = np.arange(len(i))
    while len(left):
        x = words[i[left] + n[left]] ^ words[j[left] + n[left]]
        more = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # zero bytes at the low end
        n[left] += more
        left = left[more == 8]
        left = left[n[left] < most[left]]
    return np.minimum(n, most)


def _matches(raws: list[bytes], window: int, chain: int = 32, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of the contents, one after the other: its byte, and length (or 0) and distance of the longest match among the
    latest places of the same three bytes in its content, of equal ones the nearest. Places are sorted by content and three bytes,
    so the k-th latest of all places is a shift by k."""
    size = np.array([len(x) for x in raws], np.int64)
    total = int(size.sum())
    text = np.frombuffer(b"".join(raws) + bytes(longest + 16), np.uint8)
    words = np.lib.stride_tricks.as_strided(text[:8].view("<u8"), (total + longest + 8,), (1,)).copy()
    best, back = np.zeros(total, np.int32), np.zeros(total, np.int32)
    room = np.repeat(np.cumsum(size), size) - np.arange(total)
    at = np.flatnonzero(room >= SHORTEST)
    if not len(at):
        return text[:total], best, back
    three = text[at].astype(np.uint64) << np.uint64(16) | text[at + 1].astype(np.uint64) << np.uint64(8) | text[at + 2]
    content = np.repeat(np.arange(len(raws), dtype=np.uint64), size)[at]
    width = np.uint64(total.bit_length())
    keys = np.sort((content << np.uint64(24) | three) << width | at.astype(np.uint64))
    place = (keys & (np.uint64(1) << width) - np.uint64(1)).astype(np.int32)
    keys >>= width
    n = len(place)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    before = (np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))).astype(np.int32)
    now = np.flatnonzero(before)
    i, have, most = place[now], before[now], np.minimum(room[place[now]], longest).astype(np.int32)
    length, far = np.zeros(len(now), np.int32), np.zeros(len(now), np.int32)
    for k in range(1, chain + 1):
        if not len(now):
            break
        j = place[now - k]
        open_ = (have >= k) & (i - j <= window)
        try_ = np.flatnonzero(open_ & (text[i + length] == text[j + length]))
        a, b = i[try_], j[try_]
        same = _same(words, a, b, most[try_])
        better = same > length[try_]
        try_ = try_[better]
        length[try_], far[try_] = same[better], (a - b)[better]
        keep = open_ & (length < most)
        if np.count_nonzero(keep) < 0.9 * len(now) or k == chain:
            gone = ~keep if k < chain else slice(None)
            best[i[gone]], back[i[gone]] = length[gone], far[gone]
            now, i, have, most, length, far = (x[keep] for x in (now, i, have, most, length, far))
    return text[:total], best, back


def greedy(raw: bytes, window: int, longest: int) -> Iterator[tuple[int, int]]:
    """(literal, 0) or (length, distance), greedily."""
    text, best, back = (x.tolist() for x in _matches([raw], window, longest=longest))
    i = 0
    while i < len(raw):
        yield (best[i], back[i]) if best[i] else (text[i], 0)
        i += best[i] or 1


def pack(raw: bytes) -> bytes:
    """Encodes lh5."""
    return pack_many([raw])[0]


def pack_many(raws: list[bytes]) -> list[bytes]:
    """pack of each: greedily, the longest match of the places that follow each other."""
    out: list[bytes] = []
    group: list[bytes] = []
    held = 0
    for x in raws:
        if group and (held + len(x) > SIDE or len(group) >= SIDE_CONTENTS):
            out += _packed(group)
            group, held = [], 0
        group.append(x)
        held += len(x)
    return out + _packed(group) if group else out


def _packed(raws: list[bytes]) -> list[bytes]:
    text, best, back = _matches(raws, 1 << 13)
    steps = np.maximum(best, 1).tolist()
    out, i = [], 0
    for x in raws:
        end, taken = i + len(x), []
        while i < end:
            taken.append(i)
            i += steps[i]
        at = np.array(taken, np.int64)
        symbols = np.where(back[at] > 0, best[at] + (LITERALS - SHORTEST), text[at])
        bits = [_block(symbols[k : k + BLOCK], back[at[k : k + BLOCK]].astype(np.int64)) for k in range(0, len(at), BLOCK)]
        out.append(np.packbits(np.concatenate(bits)).tobytes() if bits else b"")
    return out


def _block(symbols: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The bits of a block."""
    values: list[int] = []
    widths: list[int] = []

    def put(value: int, n: int) -> None:
        values.append(value)
        widths.append(n)

    place = np.where(back > 0, np.ceil(np.log2(np.maximum(back, 1))).astype(np.int64), 0)  # bits of back - 1
    size_s = lengths(np.bincount(symbols, minlength=N_SYMBOLS).tolist())
    size_p = lengths(np.bincount(place[back > 0], minlength=14).tolist())
    put(len(symbols), 16)
    used = [i for i, n in enumerate(size_s) if n]
    if len(used) == 1:
        for value, n in ((0, 5), (0, 5), (0, 9), (used[0], 9)):
            put(value, n)
        size_s[used[0]] = 0
    else:
        runs = list(_runs(size_s))
        count_t = [0] * 19
        for t, _, _ in runs:
            count_t[t] += 1
        size_t = lengths(count_t)
        _put_small(put, size_t, 5, 3)
        if sum(map(bool, size_t)) == 1:
            size_t = [0] * 19
        code_t = codes(size_t)
        put(used[-1] + 1, 9)
        for t, value, n in runs:
            put(code_t[t], size_t[t])
            put(value, n)
    _put_small(put, size_p, 4, None)
    if sum(map(bool, size_p)) == 1:
        size_p = [0] * 14
    code_s, code_p = np.array(codes(size_s)), np.array(codes(size_p))
    width_s, width_p = np.array(size_s), np.array(size_p)
    more = np.maximum(place - 1, 0)
    value = np.where(back > 0, (code_s[symbols] << width_p[place] | code_p[place]) << more | (back - 1 & (1 << more) - 1), code_s[symbols])
    width = width_s[symbols] + np.where(back > 0, width_p[place] + more, 0)
    return joined(np.concatenate([np.array(values, np.int64), value]), np.concatenate([np.array(widths, np.int64), width]))


def _runs(sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """The lengths up to the last used one: code, and a value with its bits for runs of zeros."""
    end = max(i for i, n in enumerate(sizes) if n) + 1
    i = 0
    while i < end:
        if sizes[i]:
            yield sizes[i] + 2, 0, 0
            i += 1
            continue
        n = next(k for k in range(i, end) if sizes[k]) - i
        i += n
        if n == 19:
            yield 0, 0, 0
            n = 18
        if n <= 2:
            yield from [(0, 0, 0)] * n
        elif n <= 18:
            yield 1, n - 3, 4
        else:
            yield 2, n - 20, 9


def _put_small(put: Callable[[int, int], None], sizes: list[int], width: int, gap: int | None) -> None:
    used = [i for i, n in enumerate(sizes) if n]
    if len(used) < 2:
        put(0, width)
        put(used[0] if used else 0, width)
        return
    end, i = used[-1] + 1, 0
    put(end, width)
    while i < end:
        k = sizes[i]
        i += 1
        put(k, 3) if k < 7 else put((1 << (k - 3)) - 2, k - 3)
        if i == gap:
            zeros = next((n for n in range(3) if sizes[i + n]), 3)
            put(zeros, 2)
            i += zeros


def larc(raw: bytes, size: int, method: str) -> bytes:
    """Decodes LArc's lzs (ring of 2 KB) and lz5 (ring of 4 KB with a prepared content)."""
    out = bytearray()
    if method == "-lzs-":
        ring, at, bits = bytearray(b" " * 2048), 2048 - 17, BitReader(raw)
        while len(out) < size:
            if bits.take(1):
                at = _ring_put(ring, at, out, bits.take(8))
            else:
                place, n = bits.take(11), bits.take(4) + 2
                for k in range(n):
                    at = _ring_put(ring, at, out, ring[(place + k) % 2048])
        return bytes(out[:size])
    fill = b"".join(bytes([i]) * 13 for i in range(256)) + bytes(range(256)) + bytes(range(255, -1, -1)) + bytes(128) + b" " * 128
    ring, at, pos = bytearray(fill[:4096]), 4096 - 18, 0
    while len(out) < size and pos < len(raw):
        flags, pos = raw[pos], pos + 1
        for bit in range(8):
            if len(out) >= size or pos >= len(raw):
                break
            if flags >> bit & 1:
                at, pos = _ring_put(ring, at, out, raw[pos]), pos + 1
            else:
                place, n = raw[pos] | (raw[pos + 1] & 0xF0) << 4, (raw[pos + 1] & 15) + 3
                pos += 2
                for k in range(n):
                    at = _ring_put(ring, at, out, ring[(place + k) % 4096])
    return bytes(out[:size])


def _ring_put(ring: bytearray, at: int, out: bytearray, b: int) -> int:
    ring[at] = b
    out.append(b)
    return (at + 1) % len(ring)


def decode(method: str, raw: bytes, size: int) -> bytes:
    """(C01)"""
    if method in STORED:
        return raw[:size]
    if method in METHODS:
        return expand(raw, size, method)
    if method == "-lh1-":
        from .lzhuf import expand as adaptive

        return adaptive(raw, size)
    if method in ("-lzs-", "-lz5-"):
        return larc(raw, size, method)
    raise ValueError(f"method {method} is not supported")


@dataclass
class Member:
    path: str
    method: str
    packed: int
    size: int
    crc: int
    offset: int
    is_dir: bool = False


def sanitized(path: str) -> str:
    return "/".join(p for p in path.replace("\\", "/").replace("\xff", "/").split("/") if p not in ("", ".", ".."))


def members(raw: bytes) -> list[Member]:
    """The members of an archive, of header levels 0, 1 and 2."""
    out, at = [], 0
    while at + 21 < len(raw) and raw[at]:
        level = raw[at + 20]
        method = raw[at + 2 : at + 7].decode("latin-1")
        packed, size = struct.unpack_from("<II", raw, at + 7)
        name, folder = b"", b""
        if level < 2:
            n = raw[at + 21]
            name = raw[at + 22 : at + 22 + n]
            (crc,) = struct.unpack_from("<H", raw, at + 22 + n)
            data = at + 2 + raw[at]
            if level == 1:
                ext = data - 2
                while length := struct.unpack_from("<H", raw, ext)[0]:
                    kind, body = raw[ext + 2], raw[ext + 3 : ext + length]
                    name, folder = (body, folder) if kind == 1 else (name, body) if kind == 2 else (name, folder)
                    ext += length
                    packed -= length
                    data += length
        elif level == 2:
            (crc,) = struct.unpack_from("<H", raw, at + 21)
            data = at + struct.unpack_from("<H", raw, at)[0]
            ext = at + 24
            while ext + 2 <= data and (length := struct.unpack_from("<H", raw, ext)[0]):
                kind, body = raw[ext + 2], raw[ext + 3 : ext + length]
                name, folder = (body, folder) if kind == 1 else (name, body) if kind == 2 else (name, folder)
                ext += length
        else:
            raise ValueError(f"header level {level} is not supported")
        path = sanitized((folder.rstrip(b"\xff\0") + b"/" + name.split(b"\0")[0]).decode("latin-1"))
        if path:
            out.append(Member(path, method, packed, size, crc, data, method == "-lhd-"))
        at = data + packed
    return out


def content(raw: bytes, m: Member) -> bytes:
    got = b"" if m.is_dir else decode(m.method, raw[m.offset : m.offset + m.packed], m.size)
    if len(got) != m.size or crc16_of(got) != m.crc:
        raise ValueError(f"{m.path}: the checksum does not match")
    return got


def member(path: str, raw: bytes, stamp: int = 0x21 << 16, store: bool = False, packed: bytes | None = None) -> bytes:
    """One member with a header of level 0; packed only if that is shorter and the content is of more than 32 bytes. packed: pack(raw),
    where it is known."""
    packed = raw if len(raw) <= 32 or store else pack(raw) if packed is None else packed
    method, packed = (b"-lh5-", packed) if len(packed) < len(raw) else (b"-lh0-", raw)
    name = path.replace("/", "\xff").encode("latin-1", "replace")[:230]
    body = method + struct.pack("<III", len(packed), len(raw), stamp) + bytes([0x20, 0, len(name)]) + name + struct.pack("<H", crc16_of(raw))
    return bytes([len(body), sum(body) & 255]) + body + packed


def archive(files: list[tuple[str, bytes]], store: bool = False) -> bytes:
    """An archive of files in the order of their paths."""
    files = sorted(files)
    packed = [None] * len(files) if store else pack_many([c for _, c in files])
    return b"".join(member(p, c, store=store, packed=x) for (p, c), x in zip(files, packed, strict=True)) + b"\0"
