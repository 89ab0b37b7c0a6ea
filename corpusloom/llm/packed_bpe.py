"""Byte-level encoding of whole slices of text at once.

The pre-token pattern is applied to arrays of code points: runs of letters, of
numbers, of white space and of the rest, then the rules on a leading space, on
the last of several spaces and on contractions.  A pre-token is known by a 64-bit
hash; an open-addressing table leads from it to its ids in one long array, and what
the table lacks is encoded once by the rank arrays of ``bpe``.  The table empties
itself when it is full, between slices, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from corpusloom.llm import kernel
from corpusloom.llm.bpe import _NEWER, Bpe

#: Slots of the table; half of them are filled at most.
SLOTS = 1 << 21
OTHER, SPACE, NUMBER, LETTER = range(4)
_HIGHEST = 0x110000


def _classes() -> np.ndarray:
    every = "".join("x" if 0xD800 <= i < 0xE000 else chr(i) for i in range(_HIGHEST))
    out = np.full(_HIGHEST, OTHER, np.uint8)
    for kind, pattern in ((LETTER, rf"[\p{{L}}--[{_NEWER}]]+"), (NUMBER, rf"[\p{{N}}--[{_NEWER}]]+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every, regex.V1):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    return out


class Table:
    """From hashes to spans of a pool of ids."""

    def __init__(self, slots: int):
        self.keys, self.at, self.count = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0
        self.shift, self.mask, self.most = np.uint64(65 - slots.bit_length()), slots - 1, slots // 2
        self.starts, self.sizes = np.zeros(self.most, np.int64), np.zeros(self.most, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def clear(self) -> None:
        self.keys[:] = 0
        self.count = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where it has none."""
        out = np.full(len(hashes), -1, np.int32)
        left, slot = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == hashes[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, hashes: np.ndarray, ids: list[tuple[int, ...]]) -> None:
        """New, distinct hashes; there must be room for them."""
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for word in ids for i in word), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), 2 * len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        entries = np.arange(self.count, self.count + len(ids))
        self.starts[entries], self.sizes[entries] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(flat), self.count + len(ids)
        left, slot = np.arange(len(ids)), (hashes >> self.shift).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            mine = self.keys[slot] == hashes[left]
            self.at[slot[mine]] = entries[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask


class PackedEncoder:
    """Ids of all texts of an Arrow column, slice by slice."""

    def __init__(self, bpe: Bpe, slots: int = SLOTS):
        self.bpe, self.table = bpe, Table(slots)
        self.kind = _classes()
        self.value = np.random.default_rng(7).integers(1, 1 << 63, _HIGHEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.special = [s.encode() for s in bpe.special]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of whole texts, where each text's ids begin, and the end)."""
        for first, _, raw, offsets in kernel.text_slices(column):
            ids, bounds = self.plain(raw, offsets)
            whole = raw.tobytes() if self.special else b""
            if any(s in whole for s in self.special):
                each = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
                    if any(s in whole[a:b] for s in self.special):
                        each[i] = np.array(self.bpe.encode(whole[a:b].decode()), np.uint32)
                ids = np.concatenate(each)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            yield first, ids, bounds

    def plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their bounds by text), as if there were no special tokens."""
        text = raw.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        firsts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=firsts[1:])
        edges = firsts[offsets]
        starts = self.pretokens(points, edges)
        ends = np.append(starts[1:], len(points))
        hashes = kernel.span_hash(kernel.running_of(self.value[points]), starts, ends)
        hashes[hashes == 0] = 1
        entries = self.table.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            fresh, at = np.unique(hashes[missing], return_index=True)
            if self.table.count + len(fresh) > self.table.most:
                self.table.clear()
                if len(hashes) > self.table.most:  # more pre-tokens than the table holds: without it
                    return self.untabled(text, starts, ends, edges)
                fresh, at = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            spans = missing[at]
            self.table.add(fresh, self.bpe.encode_words([text[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]))
            entries = self.table.find(hashes)
        sizes = self.table.sizes[entries].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.table.pool[np.repeat(self.table.starts[entries] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, edges)]

    def untabled(self, text: str, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = self.bpe.encode_words([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return np.array([i for w in words for i in w], np.uint32), before[np.searchsorted(starts, edges)]

    def pretokens(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where each pre-token begins."""
        n = len(points)
        kind = self.kind[points]
        text_start = np.zeros(n + 1, bool)
        text_start[edges] = True
        begins = text_start[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        spaced = kind == SPACE
        word_follows = np.zeros(n, bool)  # a space before what isn't one, in the same text
        word_follows[:-1] = spaced[:-1] & ~spaced[1:] & ~text_start[1:n]
        last = np.flatnonzero(word_follows)
        begins[last] = True  # the last of several spaces stands apart
        joined = last[points[last] == 0x20]  # and, if it is U+0020, opens the next pre-token
        begins[joined + 1] = False
        marks = np.flatnonzero((points == 0x27) & begins)  # an apostrophe that no space precedes
        if len(marks):
            self._contractions(points, kind, text_start, begins, marks)
        return np.flatnonzero(begins)

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, text_start: np.ndarray, begins: np.ndarray, marks: np.ndarray) -> None:
        n = len(points)
        marks = marks[marks + 1 < n]
        marks = marks[(kind[marks + 1] == LETTER) & ~text_start[marks + 1]]
        one = points[marks + 1]
        beyond = np.minimum(marks + 2, n - 1)
        two = np.where((marks + 2 < n) & ~text_start[marks + 2], points[beyond], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((marks[single], 2), (marks[double], 3)):
            begins[found + 1] = False
            rest = found + size
            rest = rest[rest < n]
            begins[rest] |= kind[rest] == LETTER
