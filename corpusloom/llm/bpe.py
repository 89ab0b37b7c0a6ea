"""Byte-pair encoding and decoding over contiguous rank arrays.

The vocabulary and merges come from a public tokenizer file whose path is a
parameter.  A word is a row of part ids beside a row of the ranks of adjacent
parts; the least rank is found by scanning, its boundary deleted and the
neighbouring ranks looked up again.  The distinct words that a worker doesn't know
yet are encoded together, a row of one array each, so that every scan, deletion
and look-up serves them all.  Words of more than ``SHORT`` symbols, where scanning
turns quadratic, keep their ranks in a heap over a linked list; both take the
leftmost pair of least rank first, so the results are the same.

Workers keep a bounded table from word to what its ids say.  Null and empty texts
give no tokens.  Repeated rows give repeated results, ids may be null, extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 128
CACHED, TOGETHER = 300_000, 1 << 15
NEVER = np.int32(2**31 - 1)
ROWS = 256

# The pre-token patterns of the two public tokenizer formats, with white space spelt out.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

# Code points that newer tables call letters or numbers, and those libraries don't yet.
NEWER = (
    "558,58B-58C,88F,C5C,CDC,208F,209D-209F,A7CE-A7CF,A7D2,A7D4,A7DD,A7E2,A7F1,AB6C-AB6D,107BB-107BF,10940-10959,10EC5-10EC7,10ED9-10EEE,11B0A,"
    "11DB0-11DDB,11DE0-11DE9,11DF1,1246F,12475-1247F,12550-12686,16EA0-16EB8,16EBB-16ED3,16FF2-16FF6,187F8-187FF,18CD6-18CDA,18D09-18D20,18D80-18DF2,"
    "18E00-19191,191A0-191D2,1B123-1B128,1B168,1D6A6,1DF1F-1DF24,1DF2B-1DF81,1DF90-1DF96,1DFCD-1DFFF,1E6C0-1E6DE,1E6E0-1E6E2,1E6E4-1E6E5,1E6E7-1E6ED,"
    "1E6F0-1E6F4,1E6FE-1E6FF,2B73A-2B73F,2B81E,2CEA2-2CEAD,323B0-33479,3D000-3FC3F"
)
# Lower case that those libraries know and Python's tables may not; first, last, first of the lower.
NEWER_CASE = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
_NEWER = "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in NEWER.split(","))
_HAS_NEWER = regex.compile(f"[{_NEWER}]").search
_CASE = {a + i: low + i for a, b, low in NEWER_CASE for i in range(b - a + 1)}
_HAS_NEWER_CASE = regex.compile("[" + "".join(map(chr, _CASE)) + "]").search


def finder(pattern: str):
    """A function from text to its pre-tokens."""
    usual = regex.compile(pattern).findall
    other, plain = r"[^\p{White_Space}\p{L}\p{N}]", {r"\p{L}": rf"[\p{{L}}--[{_NEWER}]]", r"\p{N}": rf"[\p{{N}}--[{_NEWER}]]"}
    parts = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").split(other)
    for kind, without in plain.items():
        parts = [x.replace(kind, without) for x in parts]
    exact = rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{_NEWER}]]".join(parts)
    careful = regex.compile(exact, regex.V1).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _HAS_NEWER(text):
                return careful(text)
        return usual(text)

    return find


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Special(str):
    """A special token's text; never equal to an ordinary word."""

    __slots__ = ()
    __hash__ = lambda self: hash((Special, str(self)))
    __eq__ = lambda self, other: type(other) is Special and str(self) == str(other)


class Known(dict):
    """What each word's ids say, by ``value(ids)``; emptied when full, before a group of texts."""

    def __init__(self, bpe: Bpe, value, most: int = CACHED, besides: dict = {}):  # noqa: B006  never changed
        """besides: words that needn't be learned."""
        super().__init__()
        self.bpe, self.value, self.most, self.besides = bpe, value, most, besides

    def learn(self, texts: list[list[str]]) -> None:
        every = set(chain.from_iterable(texts))
        new = [w for w in every if w not in self.besides and w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = [w for w in every if w not in self.besides]
        plain = [w for w in new if type(w) is str]
        self.update(zip(plain, map(self.value, self.bpe.encode_words(plain)), strict=True))
        if len(plain) < len(new):
            self.update((w, self.value((self.bpe.special[str(w)],))) for w in new if type(w) is Special)


class Bpe:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, spec: str | dict):
        """spec: the JSON text of the file, or what it parses to."""
        spec = json.loads(spec) if isinstance(spec, str) else spec
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.never = len(self.rank)
        self.letters = byte_characters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        of_letter = {c: b for b, c in enumerate(self.letters)}
        size = max(*self.vocab.values(), *self.special.values(), 0) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.bytes[i] = bytes(of_letter[c] for c in token.removesuffix(self.suffix) if c in of_letter)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self._tables(merges)
        self.find = finder(BYTE_LEVEL)

    def _tables(self, merges: list) -> None:
        """Arrays of the bytes' ids, the pairs' keys in order, their ranks and what they merge to."""
        self.wide = np.int64(len(self.bytes))
        of = self.vocab.get
        self.byte_id = np.array([of(c, -1) for c in self.letters], np.int32)
        self.last_id = np.array([of(c + self.suffix, -1) for c in self.letters], np.int32)
        keys = np.array([self.vocab[a] * int(self.wide) + self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int32)
        self.pair_merged = np.array([self.vocab[a + b] for a, b in merges], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NEVER where it isn't merged."""
        if not len(self.pair_keys):
            return np.full(left.shape, NEVER)
        key = left * self.wide + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NEVER)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        raws = [w.encode() for w in words]
        out: list[tuple[int, ...]] = [()] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            if len(raw) > SHORT:
                s = "".join(map(self.letters.__getitem__, raw)) + self.suffix
                out[i] = self.heap(s, [*range(len(raw)), len(s)])
            elif raw:
                by_size.setdefault(len(raw), []).append(i)
        for size, mine in by_size.items():
            for a in range(0, len(mine), TOGETHER):
                part = mine[a : a + TOGETHER]
                found, counts = self.scan(np.frombuffer(b"".join(raws[i] for i in part), np.uint8).reshape(len(part), size))
                for i, ids, n in zip(part, found.tolist(), counts.tolist(), strict=True):
                    out[i] = tuple(ids[:n])
        return out

    def scan(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in the first columns, their count) of words of equal size, a row each."""
        ids = self.byte_id[raw]
        if self.suffix:
            ids[:, -1] = self.last_id[raw[:, -1]]
        counts = np.full(len(raw), raw.shape[1])
        out = ids.copy()
        ranks = self.ranks(ids[:, :-1].astype(np.int64), ids[:, 1:])
        rows = np.arange(len(raw))
        while ranks.shape[1]:
            j = ranks.argmin(1)
            least = ranks[np.arange(len(j)), j]
            busy = least < NEVER
            if not busy.all():
                done = rows[~busy]
                out[done, : ids.shape[1]] = ids[~busy]
                counts[done] = ids.shape[1]
                ids, ranks, rows, j, least = ids[busy], ranks[busy], rows[busy], j[busy], least[busy]
                if not len(rows):
                    return out, counts
            here = np.arange(len(rows))
            cut = np.arange(ids.shape[1] - 1) > j[:, None]  # columns after the deleted boundary move left
            ids[here, j] = self.pair_merged[least]
            ids = np.where(cut, ids[:, 1:], ids[:, :-1])
            ranks = np.where(cut[:, :-1] | (np.arange(ranks.shape[1] - 1) >= j[:, None]), ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                after = np.flatnonzero(j < ranks.shape[1])
                ranks[after, j[after]] = self.ranks(ids[after, j[after]].astype(np.int64), ids[after, j[after] + 1])
                before = np.flatnonzero(j > 0)
                ranks[before, j[before] - 1] = self.ranks(ids[before, j[before] - 1].astype(np.int64), ids[before, j[before]])
        out[rows, : ids.shape[1]] = ids
        counts[rows] = ids.shape[1]
        return out, counts

    def heap(self, s: str, bounds: list[int]) -> tuple[int, ...]:
        n = len(bounds) - 1
        start, end, after, before = bounds[:-1], bounds[1:], [*range(1, n), -1], list(range(-1, n - 1))
        rank, never = self.rank.get, self.never
        waiting: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := rank((s[start[i] : end[i]], s[start[j] : end[j]]), never)) < never:
                heapq.heappush(waiting, (r, i, end[i], end[j]))

        for i in range(n):
            push(i)
        while waiting:
            _, i, mid, stop = heapq.heappop(waiting)
            j = after[i]
            if end[i] != mid or j < 0 or end[j] != stop:
                continue
            end[i], after[i] = stop, after[j]
            end[j] = -1
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(self.vocab[s[start[i] : end[i]]])
            i = after[i]
        return tuple(out)

    def pieces(self, text: str):
        """Yields (plain text, None) and (special token, its id)."""
        done = 0
        if self.split and "<|" in text or self.split and not all(t.startswith("<|") for t in self.special):
            for m in self.split.finditer(text):
                yield text[done : m.start()], None
                yield m[0], self.special[m[0]]
                done = m.end()
        yield (text[done:] if done else text), None

    def split_text(self, text: str) -> list[str]:
        """Pre-tokens and special tokens; of the latter none can be an ordinary pre-token's text."""
        out: list[str] = []
        for piece, special in self.pieces(text):
            if special is not None:
                out.append(Special(piece))
            elif piece:
                out.extend(self.find(piece))
        return out

    def encode(self, text: str) -> list[int]:
        words = self.split_text(text)
        found = iter(self.encode_words([w for w in words if type(w) is str]))
        return list(chain.from_iterable((self.special[str(w)],) if type(w) is Special else next(found) for w in words))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def lower_each(text: str) -> str:
    """Lower case of each character by itself: no final sigma."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class WordEnds(Bpe):
    """The variant with word ends: NFC, lower case, white space dropped."""

    def __init__(self, spec: str | dict):
        super().__init__(spec)
        found = finder(WORD_LEVEL)
        self.find = lambda text: found(self.normal(text))

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = lower_each(unicodedata.normalize("NFC", text))
        return text.translate(_CASE) if _HAS_NEWER_CASE(text) else text


_LOADED: dict[tuple[str, type], Bpe] = {}


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def ship(spark, path: str) -> str:
    """Sends the tokenizer file to every executor; returns its name there."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def worker(name: str, kind: type = Bpe) -> Bpe:
    """The tokenizer of a shipped file, loaded once by a Python worker."""
    if (name, kind) not in _LOADED:
        _LOADED[name, kind] = kind(read_spec(SparkFiles.get(name)))
    return _LOADED[name, kind]


ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def _encoded(batches, name: str):
    bpe = worker(name)
    known = Known(bpe, lambda ids: ids)
    for key, texts in _texts(batches):
        split = [bpe.split_text(t) for t in texts]
        known.learn(split)
        ids = [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
        yield pa.RecordBatch.from_arrays(
            [key, pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())],
            ["doc_id", "n_tokens", "ids", "decoded"],
        )


def _digested(batches, name: str):
    bpe = worker(name)
    known = Known(bpe, lambda ids: (len(ids), ",".join(map(bpe.decimal.__getitem__, ids)), b"".join(map(bpe.bytes.__getitem__, ids))))
    for key, texts in _texts(batches):
        split = [bpe.split_text(t) for t in texts]
        known.learn(split)
        rows = []
        for words in split:
            n, ids, raw = zip(*map(known.__getitem__, words), strict=True) if words else ((), (), ())
            decoded = b"".join(raw).decode("utf-8", "replace").encode()
            rows.append((sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        n, one, two = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: its ids and what they decode to, or the SHA-256 of both.

    The digests are taken beside the encoder, so that ids of 100 TB of text
    needn't leave the worker when only they are wanted.
    """
    name = ship(docs.sparkSession, tokenizer)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    run = _digested if digests else _encoded
    return source.mapInArrow(lambda batches: run(batches, name), DIGESTS if digests else ENCODED)
