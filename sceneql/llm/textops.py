"""Vectorised text kernels over Arrow string columns.

Words are maximal runs of bytes other than space and \\x09-\\x0D, as UTF-8.
Every kernel works on the column's own buffers: no Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but ASCII letters and bytes of longer characters: what parts words without their punctuation.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False

_U = np.uint64
_LETTERS = np.arange(256, dtype=np.uint8)

#: The byte that each byte counts as: itself, or with LOWER a-z for A-Z.
EXACT = _LETTERS.copy()
LOWER = _LETTERS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32

#: What 0 to 8 bytes leave of eight, read as a little-endian number.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 18):
    """Row ranges of about `most` bytes each, so that temporaries stay small; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(raw: np.ndarray, off: np.ndarray, table: np.ndarray = EXACT, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of each row's first word and the end, start byte, end byte)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z
    gap = gaps[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    before |= first[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after |= first[1:]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return word_hashes(raw if table is EXACT else table[raw], starts, ends), np.searchsorted(starts, off, "left"), starts, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range: a sum of what a mixing function makes of eight bytes and their place in the range.

    The function isn't linear, so no repetition or rearrangement within a word makes two words' sums meet other than by
    chance (2**-64 a pair), as they do for powers of a base.
    """
    wide = np.ndarray(len(raw), dtype="<u8", buffer=np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    length = ends - starts
    h = mix((wide[starts] & _MASKS[np.minimum(length, 8)]) * _U(0x9E3779B97F4A7C15) + length.astype(np.uint64))
    long_ = np.flatnonzero(length > 8)
    if len(long_):
        more = -(-length[long_] // 8) - 1
        place = ranges(np.ones(len(long_), np.int64), more)
        at = np.repeat(starts[long_], more) + 8 * place
        part = wide[at] & _MASKS[np.minimum(np.repeat(ends[long_], more) - at, 8)]
        x = mix(part ^ mix(place.astype(np.uint64) * _U(0xA24BAED4963EE407)))
        h[long_] = mix(h[long_] + np.add.reduceat(x, np.cumsum(more) - more))
    return h


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix(mix(x + _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9) + y)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words of one buffer, rows not told apart: callers drop those that cross a row's end.

    Runs of 1, 2, 4, .. words are joined in pairs, and those of k's binary digits one after the other.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, run, size = None, 0, h, 1
    while True:
        if k & size:
            part = run[at : at + n]
            out = part if out is None else joined(out, part)
            at += size
        if 2 * size > k:
            return mix(out ^ _U(0x2545F4914F6CDD1D))
        run = joined(run[:-size], run[size:])
        size *= 2


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive numbers, in three passes over the array."""
    n = len(x)
    if n < w:
        return x[:0]
    m = -(-n // w) * w
    y = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... for each i, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)
