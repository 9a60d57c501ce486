"""Floppy tracks: MFM sectors, flux series, and two containers for them."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SYNC = 0x4489
DATA_BITS = 0x55555555
SECTOR, PER_TRACK, TRACKS = 512, 11, 160
#: Seconds of a cell by density.
CELL = {11: 2e-6, 22: 1e-6}


def split(raw: bytes) -> bytes:
    """Odd bits, then even bits, as data bits of MFM cells without clock."""
    v = np.frombuffer(raw, np.uint8)
    return ((v >> 1) & 0x55).tobytes() + (v & 0x55).tobytes()


def merge(raw: bytes) -> bytes:
    v = np.frombuffer(raw, np.uint8) & 0x55
    n = len(v) // 2
    return ((v[:n] << 1) | v[n : 2 * n]).tobytes()


def checksum(raw: bytes) -> int:
    """The exclusive or of longs, on the data bits."""
    v = np.frombuffer(raw, ">u4")
    return int(np.bitwise_xor.reduce(v)) & DATA_BITS if len(v) else 0


def clocked(raw: bytes, before: int = 0) -> bytes:
    """Clock bits set between two zero data bits."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    data = bits[1::2]
    last = np.concatenate([[before], data[:-1]])
    bits[0::2] = (data | last) ^ 1
    return np.packbits(bits).tobytes()


def pack_cells(cells: bytes) -> bytes:
    """Cells as codes of two bits, the first in the high bits: 1 a zero, 2 a one, 0 the end and what fills the last byte."""
    codes = np.unpackbits(np.frombuffer(cells, np.uint8)) + np.uint8(1)
    four = np.append(codes, np.zeros(4 - len(codes) % 4, np.uint8)).reshape(-1, 4)
    return (four << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def unpack_cells(packed: bytes) -> bytes:
    """The cells up to the first code that is neither a zero nor a one."""
    codes = (np.frombuffer(packed, np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()
    end = np.flatnonzero((codes == 0) | (codes == 3))
    return np.packbits(codes[: end[0] if len(end) else None] == 2).tobytes()


def encode_track(track: int, sectors: list[bytes]) -> bytes:
    """The cells of a track: for each sector two sync words, the header, its checksum, and the data with theirs."""
    out = bytearray()
    n = len(sectors)
    for s, data in enumerate(sectors):
        head = split(bytes([0xFF, track, s, n - s])) + split(bytes(16))
        body = split(data)
        sums = split(struct.pack(">I", checksum(head))), split(struct.pack(">I", checksum(body)))
        last = out[-1] & 1 if out else 0
        out += clocked(b"\0\0\0\0", last) + struct.pack(">HH", SYNC, SYNC)
        out += clocked(head + sums[0] + sums[1] + body, 1)
    return bytes(out) + clocked(bytes(700 if n == PER_TRACK else 1400), out[-1] & 1 if out else 0)


@dataclass
class Sector:
    track: int
    sector: int
    at: int
    head_ok: bool
    data_ok: bool
    data: bytes


def find_syncs(bits: np.ndarray) -> np.ndarray:
    """The bit after each pair of sync words."""
    pattern, out = struct.pack(">HH", SYNC, SYNC), []
    for shift in range(8):
        raw = np.packbits(bits[shift:]).tobytes()
        at = raw.find(pattern)
        while at >= 0:
            out.append(8 * at + shift + 8 * len(pattern))
            at = raw.find(pattern, at + 1)
    return np.array(sorted(x for x in out if x <= len(bits)), np.int64)


def decode_track(cells: bytes | np.ndarray) -> list[Sector]:
    """All sectors of a series of cells, valid or not, in order of place."""
    bits = np.unpackbits(np.frombuffer(cells, np.uint8)) if isinstance(cells, (bytes, bytearray)) else cells
    out = []
    size = 8 + 32 + 8 + 8 + 2 * SECTOR
    for at in find_syncs(bits).tolist():
        part = bits[at : at + 8 * size]
        if len(part) < 8 * size:
            continue
        raw = np.packbits(part).tobytes()
        head, head_sum, data_sum, body = raw[:40], raw[40:48], raw[48:56], raw[56:]
        info = merge(head[:8])
        head_ok = struct.unpack(">I", merge(head_sum))[0] == checksum(head) and info[0] == 0xFF
        data_ok = struct.unpack(">I", merge(data_sum))[0] == checksum(body)
        out.append(Sector(info[1], info[2], at, head_ok, data_ok, merge(body)))
    return out


def recovered(copies: list[Sector]) -> dict[tuple[int, int], bytes]:
    """Of each sector the first valid copy."""
    out: dict[tuple[int, int], bytes] = {}
    for c in copies:
        if c.head_ok and c.data_ok:
            out.setdefault((c.track, c.sector), c.data)
    return out


def intervals(cells: bytes, cell: float, ticks_per_second: float) -> np.ndarray:
    """The series of times between flux changes of a track that goes round, in ticks."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(cells, np.uint8)))
    edge = np.rint((at + 1) * cell * ticks_per_second).astype(np.int64)
    return np.diff(edge, prepend=0)


GAIN, SLOWEST, FASTEST = 0.10, 0.7, 1.4


def cells_of(ticks: np.ndarray, cell: float, ticks_per_second: float) -> np.ndarray:
    """Cells from a series by a phase-locked loop whose cell follows the series."""
    return cells_of_many([ticks], cell, ticks_per_second)[0]


#: Intervals of each series that are laid side by side at a time.
SPAN = 1024


def cells_of_many(series: list[np.ndarray], cell: float, ticks_per_second: float) -> list[np.ndarray]:
    """cells_of each: the loops of all series run side by side, the longest first, an interval of each at a step."""
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))
    long = np.array([len(series[i]) for i in order])
    now = np.full(len(series), cell)
    counts = [np.zeros(len(series[i]), np.int32) for i in order]
    for at in range(0, int(long[0]) if len(long) else 0, SPAN):
        k = int(np.count_nonzero(long > at))
        times = np.ones((SPAN, k))
        for i in range(k):
            part = series[order[i]][at : at + SPAN]
            times[: len(part), i] = part
        times /= ticks_per_second
        n = np.empty((SPAN, k), np.int32)
        for r, c in enumerate(np.searchsorted(-long[:k], -np.arange(at, min(at + SPAN, long[0])), "left").tolist()):
            t, w = times[r, :c], now[:c]
            x = np.maximum(np.floor(t / w + 0.5), 1)  # halves go up
            n[r, :c] = x
            now[:c] = np.minimum(np.maximum(w + GAIN * (t / x - w), cell * SLOWEST), cell * FASTEST)
        for i in range(k):
            counts[i][at : at + SPAN] = n[: min(SPAN, long[i] - at), i]
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(series)
    for i, n in zip(order, counts, strict=True):
        places = np.cumsum(n, dtype=np.int64)
        out[i] = np.zeros(int(places[-1]) if len(n) else 0, np.uint8)
        out[i][places - 1] = 1
    return out


def disk_image(series: dict[int, list[np.ndarray]], ticks_per_second: float, per_track: int = PER_TRACK) -> tuple[bytes, dict[int, int]]:
    """The image of a disk from the revolutions of each track, and how many sectors each track has. Missing ones are zeros."""
    out, found = bytearray(TRACKS * per_track * SECTOR), {}
    for track in range(TRACKS):
        copies = [s for ticks in series.get(track, []) for s in decode_track(cells_of(ticks, CELL[per_track], ticks_per_second))]
        good = {s: d for (t, s), d in recovered(copies).items() if t == track and s < per_track}
        found[track] = len(good)
        for s, d in good.items():
            at = (track * per_track + s) * SECTOR
            out[at : at + SECTOR] = d
    return bytes(out), found


# --- SCP images: a table of 168 tracks; revolutions of big-endian words, where zero stands for 65536 more ---------------------

SCP_TRACKS, SCP_UNIT = 168, 25e-9


def scp_words(ticks: np.ndarray) -> bytes:
    t = np.asarray(ticks, np.int64)
    last = np.maximum(t % 65536, 1)  # a word of zero says nothing of its own: a tick more
    zeros = np.where(t % 65536, t // 65536, np.maximum(t // 65536 - 1, 0))
    whole = (t % 65536 == 0).astype(np.int64)  # one zero more
    at = np.cumsum(zeros + whole + 1) - 1
    out = np.zeros(int(at[-1]) + 1 if len(t) else 0, ">u2")
    out[at] = last
    return out.tobytes()


def scp_ticks(raw: bytes) -> np.ndarray:
    """(O05) Zeros add 65536 to the word that follows; zeros at the end are nothing."""
    w = np.frombuffer(raw, ">u2").astype(np.int64)
    island = np.concatenate([[0], np.cumsum(w != 0)[:-1]]) if len(w) else w
    sums = np.bincount(island, np.where(w == 0, 65536, w)).astype(np.int64) if len(w) else w
    return sums[: int((w != 0).sum())]


def _byte_sum(raw: bytes) -> int:
    return int(np.frombuffer(raw, np.uint8).sum(dtype=np.uint64)) & 0xFFFFFFFF


def scp_encode(tracks: dict[int, list[np.ndarray]], revolutions: int) -> bytes:
    """(W18)"""
    table, body = [0] * SCP_TRACKS, bytearray()
    for t in sorted(tracks):
        table[t] = 0x10 + 4 * SCP_TRACKS + len(body)
        heads, data = b"", b""
        for ticks in tracks[t]:
            words = scp_words(ticks)
            heads += struct.pack("<III", int(np.sum(ticks)), len(words) // 2, 4 + 12 * len(tracks[t]) + len(data))
            data += words
        body += b"TRK" + bytes([t]) + heads + data
    rest = struct.pack(f"<{SCP_TRACKS}I", *table) + bytes(body)
    first, last = (min(tracks), max(tracks)) if tracks else (0, 0)
    return b"SCP" + bytes([0x24, 4, revolutions, first, last, 1, 0, 0, 0]) + struct.pack("<I", _byte_sum(rest)) + rest


def scp_decode(raw: bytes) -> dict[int, list[np.ndarray]]:
    """(S42)"""
    if raw[:3] != b"SCP":
        raise ValueError("not an SCP image")
    n = raw[5]
    out = {}
    for t, at in enumerate(struct.unpack_from(f"<{SCP_TRACKS}I", raw, 0x10)):
        if at and raw[at : at + 3] == b"TRK":
            heads = [struct.unpack_from("<III", raw, at + 4 + 12 * r) for r in range(n)]
            out[t] = [scp_ticks(raw[at + o : at + o + 2 * words]) for _, words, o in heads]
    return out


def scp_checksum_ok(raw: bytes) -> bool:
    """(A09)"""
    return struct.unpack_from("<I", raw, 12)[0] == _byte_sum(raw[0x10:])


# --- a byte stream of intervals: one byte up to 249, two up to 1524, else an opcode with four bytes of seven bits -----------------

_SPACE, _INDEX = 2, 1


def _n28(x: int) -> bytes:
    return bytes([1 | (x << 1) & 255, 1 | (x >> 6) & 255, 1 | (x >> 13) & 255, 1 | (x >> 20) & 255])


def stream_encode(ticks: np.ndarray) -> bytes:
    """(W19)"""
    out = bytearray()
    for t in np.asarray(ticks).tolist():
        if t == 0:
            continue
        if t < 250:
            out.append(t)
            continue
        if t >= 1525:
            out += bytes([255, _SPACE]) + _n28(t - 249)
            t = 249
        out += bytes([t]) if t < 250 else bytes([250 + (t - 250) // 255, 1 + (t - 250) % 255])
    return bytes(out) + b"\0"


def stream_decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Intervals, and the places of index pulses as sums of ticks."""
    out, index, held, total, i = [], [], 0, 0, 0
    while i < len(raw) and raw[i]:
        b = raw[i]
        if b == 255:
            v = sum((raw[i + 2 + k] & 0xFE) << (7 * k) for k in range(4)) >> 1
            if raw[i + 1] == _SPACE:
                held += v
            else:
                index.append(total + held + v)
            i += 6
            continue
        t = b if b < 250 else 250 + (b - 250) * 255 + raw[i + 1] - 1
        i += 1 if b < 250 else 2
        out.append(held + t)
        total += held + t
        held = 0
    return np.array(out, np.int64), np.array(index, np.int64)
