"""Vectorised word and byte hashing over the UTF-8 buffers of Arrow columns.

A word, shingle or byte string is known by a 64-bit hash: a polynomial over a
random byte table, taken from running sums so that every position costs a few
array passes, then mixed.  Texts are handled in slices of about ``SLICE`` bytes;
a text is never cut, so memory is bounded by the slice or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: White space splits words; A-Z becomes a-z.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[ord("A") : ord("Z") + 1] += 32
SPACED[[0x20, *range(0x09, 0x0E)]] = 0
#: As above, but case is kept.  NUL is an ordinary character, kept apart from separators by WORD.
#: Only ASCII letters and digits and all bytes of non-ASCII characters form words.
ALNUM = np.zeros(256, np.uint8)
ALNUM[0x30:0x3A] = np.arange(0x30, 0x3A)
ALNUM[0x61:0x7B] = np.arange(0x61, 0x7B)
ALNUM[0x41:0x5B] = np.arange(0x61, 0x7B)
ALNUM[0x80:] = np.arange(0x80, 0x100)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE + (1 << 17))
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) for runs of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def running(folded: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash takes the hash of any span of bytes."""
    return running_of(_BYTE[folded])


def running_of(values: np.ndarray) -> np.ndarray:
    """The same for spans of 64-bit values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word and the words' offsets by text.

    ``table`` maps bytes to their folded form, 0 for separators (NUL included
    where the pattern makes it one; else see ``word_hashes``).
    """
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[raw] != 0
    if table is SPACED:
        inside[1:-1] |= raw == 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the words' offsets by text."""
    starts, ends, by_text = words(raw, offsets, table)
    return span_hash(running(table[raw]), starts, ends), by_text


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words at each position where so many follow, across texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (int(size) * int(_ODD[63])) % (1 << 64), np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * _ODD[j % 60] + np.uint64(j)
    return mix(out)


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, as gram_hashes has it."""
    return gram_hashes(hashes, len(hashes))[0]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by blockwise running minima from both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    if width == 1:
        return values
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
