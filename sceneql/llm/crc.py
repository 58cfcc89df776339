"""CRC-32 of many byte ranges at once, and where runs of bytes begin and end."""

from __future__ import annotations

import zlib

import numpy as np

#: Ranges longer than this go to zlib one by one.
LONG = 256
_FULL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _table()


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every maximal run of bytes that are inside, within each row."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[off] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    before[0] = after[-1] = True
    starts, ends = np.flatnonzero(before & inside), np.flatnonzero(after & inside) + 1
    return np.searchsorted(off, starts, "right") - 1, starts, ends


def begun(n: int, values: np.ndarray | None = None) -> np.ndarray:
    """States of n checksums: new ones, or those that go on from finished values."""
    return np.full(n, _FULL) if values is None else values.astype(np.uint32) ^ _FULL


def done(state: np.ndarray) -> np.ndarray:
    """Unsigned checksums as longs."""
    return (state ^ _FULL).astype(np.int64)


def byte(state: np.ndarray, value: int) -> np.ndarray:
    """The states after one more byte, the same for all."""
    return _TABLE[(state ^ np.uint32(value)) & np.uint32(255)] ^ (state >> np.uint32(8))


def more(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states after the bytes of each range: byte by byte, all ranges that are long enough together."""
    state, length = state.copy(), ends - starts
    for i in np.flatnonzero(length > LONG):
        value = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(state[i] ^ _FULL))
        state[i] = np.uint32(value) ^ _FULL
    live = np.flatnonzero((length > 0) & (length <= LONG))
    k = 0
    while len(live):
        s = state[live]
        state[live] = _TABLE[(s ^ raw[starts[live] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
        k += 1
        live = live[length[live] > k]
    return state
