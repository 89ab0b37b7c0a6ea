"""Removal of long repeated strings through a distributed, sparse suffix array.

A text is a sequence of symbols: of its UTF-8 bytes (``BYTES``), or of its words
(``WORDS``: split at white space, A-Z lower-cased, each known by 64 bits).  A symbol
goes if it lies in a string of ``length`` symbols that starts anywhere else too, in
any text; strings are judged on the input.

Sorting every suffix with ``length`` symbols behind it would move the corpus
hundreds of times.  Instead suffixes start at *anchors*: of all ``k``-grams in a
window of ``length`` symbols the one of least hash (the leftmost of ties).  Equal
windows have the same anchor at the same place, so all repeats are found among
suffixes that start alike.

1. Each text gives its anchors: hash of the k-gram, hash of the *context* (the
   symbols that windows around the anchor can reach), position.  Only anchors whose
   k-gram occurs twice go on; counts are summed before the shuffle.
2. Equal contexts, the case of copies, are counted without moving their symbols:
   their whole reach is repeated.  One context each of differing ones is cut out.
3. Those suffixes are range-partitioned by their leading symbols with sampled
   splitters.  Each partition sorts them, and the reversed symbols before their
   anchors, by multikey quicksort.  Neighbours' common prefixes tell, for every
   way a window can lie around the anchor, which contexts share it.  A splitter
   never parts equal k-grams, and a k-gram with more than ``hot`` contexts is
   compared across partitions instead, by the hashes of its windows.
4. The reach goes back to every occurrence, and texts are cut.

The plan is the same at every size.  Texts are shuffled by id and hash to meet
what is to be cut from them: once for the contexts and once at the end; what both
meet is written before, so that Spark can split the partitions of a hot key.

Null and short texts lose nothing; equal rows are repeats of each other; a null
id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.llm.scratch import Scratch, unused


class Unit(NamedTuple):
    """What a text is a sequence of; ``code`` is the last bit of its keys, ``width`` a symbol's bytes."""

    code: int
    width: int
    length: int
    k: int


BYTES, WORDS = Unit(0, 1, 400, 128), Unit(1, 8, 50, 10)
BOTH = (BYTES, WORDS)
HOT = 20_000


def symbols(unit: Unit, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a slice of texts and their offsets by text."""
    if unit.code == BYTES.code:
        return raw, offsets
    return kernel.word_hashes(raw, offsets, kernel.SPACED)


def anchors(unit: Unit, found: np.ndarray, offsets: np.ndarray):
    """(text, position, left, right, key, context hash) of every anchor of a slice of texts as symbols."""
    length, k, n = unit.length, unit.k, len(found)
    if n < length:
        return None
    sums = kernel.running(found) if unit.width == 1 else kernel.running_of(found | np.uint64(1))
    at = np.arange(n - k + 1)
    grams = kernel.span_hash(sums, at, at + k)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = (kernel.window_minima(packed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    inside = at[: len(least)] + length <= ends[: len(least)]
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    pos = least[fresh]
    text = np.searchsorted(offsets, pos, "right") - 1
    left = np.minimum(pos - offsets[text], length - k)
    right = np.minimum(offsets[text + 1] - pos, length)
    context = kernel.mix(kernel.span_hash(sums, pos - left, pos + right) ^ kernel.mix((left * (1 << 20) + right).astype(np.uint64)))
    key = grams[pos] & ~np.uint64(1) | np.uint64(unit.code)
    return text, pos - offsets[text], left, right, key, context


ANCHORS = "doc_id long, fp long, pos long, left int, right int, key long, context long"


def _anchored(batches, units):
    names = [x.split()[0] for x in ANCHORS.split(", ")]
    for batch in batches:
        for a, _, raw, offsets in kernel.text_slices(batch.column(2)):
            for unit in units:
                found = anchors(unit, *symbols(unit, raw, offsets))
                if found is None or not len(found[0]):
                    continue
                text, pos, left, right, key, context = found
                take = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(kernel.as_long(key)), pa.array(kernel.as_long(context))], names
                )


PIECES = "key long, context long, before binary, after binary"


def _cut(batches, units):
    """The symbols before (reversed) and after every anchor that is to be cut out."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            keys, contexts, before, after = [], [], [], []
            for x, y, raw, offsets in kernel.text_slices(part.column(0)):
                read = {u.code: symbols(u, raw, offsets) for u in units}
                for i, cuts in enumerate(part.column(1).slice(x, y - x).to_pylist()):
                    for c in cuts:
                        found, at = read[c["key"] & 1]
                        p = int(at[i]) + c["pos"]
                        keys.append(c["key"])
                        contexts.append(c["context"])
                        around = found[p - c["left"] : p + c["right"]].astype(found.dtype.newbyteorder(">"))
                        before.append(around[: c["left"]][::-1].tobytes())
                        after.append(around[c["left"] :].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contexts, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["key", "context", "before", "after"])


def matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of ``width`` bytes, and as 8-byte characters followed by the length."""
    lengths = np.array(list(map(len, strings)), np.int64)
    wide = -(-width // 8) * 8
    rows = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(len(strings), wide)
    chars = rows.view(">u8").astype(np.uint64)
    return rows[:, :width], np.hstack([chars, lengths[:, None].astype(np.uint64)])


def multikey_order(chars: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows sorted by group, then by characters: multikey quicksort, all its open parts in step.

    Each part is split by its middle row's character at its depth into less,
    equal and greater; the equal part goes one character deeper.
    """
    order = np.argsort(group, kind="stable")
    n, depths = len(order), chars.shape[1]
    slots = np.arange(n)
    fresh = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if n else np.zeros(0, bool)
    depth = np.zeros(n, np.int64)
    while len(slots):
        at = np.flatnonzero(fresh)
        sizes = np.diff(np.append(at, len(slots)))
        start, size = np.repeat(slots[at], sizes), np.repeat(sizes, sizes)
        open_ = (size > 1) & (depth < depths)
        slots, start, size, depth = slots[open_], start[open_], size[open_], depth[open_]
        if not len(slots):
            break
        rows = order[slots]
        pivot, mine = chars[order[start + size // 2], depth], chars[rows, depth]
        side = (mine >= pivot).astype(np.int64) + (mine > pivot)
        part = start * 3 + side
        by = np.argsort(part, kind="stable")
        order[slots] = rows[by]
        part, depth = part[by], depth[by] + (side[by] == 1)
        fresh = np.concatenate([[True], part[1:] != part[:-1]])
    return order


def common(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in order; -1 at the start of a group."""
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    out = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out = np.minimum(out, np.minimum(lengths[a], lengths[b]))
    return np.concatenate([[-1], np.where(group[a] == group[b], out, -1)])


def reach(unit: Unit, group: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many symbols before and after its anchor each context is repeated in another of its group (0, 0: not)."""
    span, w = unit.length - unit.k, unit.width
    rest = [s[unit.k * w :] for s in after]
    lb, lr = np.array(list(map(len, before)), np.int64), np.array(list(map(len, rest)), np.int64)
    rows_b, chars_b = matrix(before, span * w)
    rows_r, chars_r = matrix(rest, span * w)
    order_b, order_r = multikey_order(chars_b, group), multikey_order(chars_r, group)
    common_b, common_r = common(rows_b, lb, order_b, group) // w, common(rows_r, lr, order_r, group) // w
    lb, lr = lb // w, lr // w
    n = len(group)
    class_b, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    most, least = np.full(n, -1, np.int64), np.full(n, span + 1, np.int64)
    # No window with more symbols before the anchor, or after it, than any two contexts share there.
    for o in range(max(0, span - int(common_r.max())), min(span, int(common_b.max())) + 1):
        class_b[order_b] = np.cumsum(common_b < o)
        class_r[order_r] = np.cumsum(common_r < span - o)
        pair = np.where((lb >= o) & (lr >= span - o), class_b * (n + 1) + class_r, -1 - np.arange(n))
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        again = np.zeros(n, bool)
        again[by[1:][same]] = again[by[:-1][same]] = True
        most[again] = o
        least[again] = np.minimum(least[again], o)
    found = most >= 0
    return np.where(found, most, 0), np.where(found, unit.length - least, 0)


REACH = "key long, context long, l long, r long"


def _sorted(batches, units):
    def rows():
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                yield from zip(*(batch.column(i).slice(a, 1024).to_pylist() for i in range(4)), strict=True)

    def solve(unit, held):
        keys, contexts, before, after = zip(*held, strict=True)
        group = np.unique(np.array(keys, np.int64), return_inverse=True)[1]
        left, right = reach(unit, group, list(before), list(after))
        use = right > 0
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[use]), pa.array(np.array(contexts, np.int64)[use]), pa.array(left[use]), pa.array(right[use])], ["key", "context", "l", "r"])

    by_code: dict[int, tuple[Unit, list]] = {u.code: (u, []) for u in units}
    for key, same in groupby(rows(), key=lambda r: r[0]):
        unit, held = by_code[key & 1]
        held.extend(same)
        if len(held) >= 4000:
            yield solve(unit, held)
            held.clear()
    for unit, held in by_code.values():
        if held:
            yield solve(unit, held)


WINDOWS = "key long, context long, o long, h long"


def _windows(batches, units):
    by_code = {u.code: u for u in units}
    for batch in batches:
        for key, context, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            unit = by_code[key & 1]
            kind = np.dtype(np.uint8 if unit.width == 1 else ">u8")
            found = np.concatenate([np.frombuffer(before, kind)[::-1], np.frombuffer(after, kind)])
            sums = kernel.running(found) if unit.width == 1 else kernel.running_of(found.astype(np.uint64))
            start = np.arange(len(found) - unit.length + 1)
            start = start[start <= len(before) // unit.width]
            h = kernel.span_hash(sums, start, start + unit.length)
            n = len(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, context)), pa.array(len(before) // unit.width - start), pa.array(kernel.as_long(h))], ["key", "context", "o", "h"])


def merged(spans: list, code: int) -> list[list[int]]:
    """The maximal runs of a unit's spans."""
    out: list[list[int]] = []
    for x, y in sorted((s["a"], s["b"]) for s in spans if s["unit"] == code):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def without(raw: bytes, runs: list[list[int]]) -> bytes:
    edges = [0, *(p for run in runs for p in run), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def word_runs(raw: bytes, spans: list) -> list[list[int]]:
    """The bytes of the maximal runs of repeated words."""
    runs = merged(spans, WORDS.code)
    if not runs:
        return runs
    starts, ends, _ = kernel.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), kernel.SPACED)
    return [[int(starts[a]), int(ends[b - 1])] for a, b in runs]


RESULT = "doc_id long, fp long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long, n_passage_words long"


def _removed(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            out = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                runs, passages = merged(spans or (), BYTES.code), merged(spans or (), WORDS.code)
                kept = without(raw, runs)
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, len(passages), sum(y - x for x, y in passages)))
            n, gone, spans, digest, kept, passages, words = zip(*out, strict=True)
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), longs(n), longs(gone), longs(spans), pa.array(digest), pa.array(kept, pa.binary()), longs(passages), longs(words)], [x.split()[0] for x in RESULT.split(", ")])


def repeated_spans(docs: DataFrame, scratch: Scratch, units: tuple[Unit, ...]) -> DataFrame:
    """(doc_id, fp, spans): the spans (unit, a, b) of each text of docs (doc_id, fp, text) to remove, not yet merged."""
    found = scratch.table(docs.mapInArrow(partial(_anchored, units=units), ANCHORS), "anchors")
    twice = scratch.table(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
    again = scratch.table(found.join(twice, "key", "left_semi"), "candidates")
    scratch.drop("anchors", "twice")
    place = F.min(F.struct("doc_id", "fp", "pos")).alias("at")
    contexts = again.groupBy("key", "context").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"), place)
    contexts = scratch.table(contexts, "contexts")
    kinds = scratch.table(contexts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    several = contexts.join(kinds, "key").select("key", "context", "left", "right", "at.*")
    cuts = several.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("key", "context", "pos", "left", "right")).alias("cuts"))
    cuts = scratch.table(cuts, "cuts")
    same = docs["doc_id"].eqNullSafe(cuts["doc_id"]) & (docs["fp"] == cuts["fp"])
    pieces = docs.join(cuts.hint("merge"), same).select("text", "cuts").mapInArrow(partial(_cut, units=units), PIECES)
    pieces = scratch.table(pieces, "pieces")
    hot = scratch.table(kinds.where(F.col("kinds") > HOT).select("key"), "hot")
    lead = F.substring("after", 1, 16)
    some_hot = hot.limit(1).count() > 0
    usual = pieces.join(hot, "key", "left_anti") if some_hot else pieces
    dealt = usual.repartitionByRange(lead, "key").sortWithinPartitions(lead, "key")
    result = dealt.mapInArrow(partial(_sorted, units=units), REACH)
    if some_hot:
        windows = pieces.join(hot, "key", "left_semi").mapInArrow(partial(_windows, units=units), WINDOWS)
        shared = windows.groupBy("key", "h", "o").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        length = F.when(F.col("key").bitwiseAND(1) == WORDS.code, WORDS.length).otherwise(BYTES.length)
        wide = windows.join(shared, ["key", "h", "o"], "left_semi").groupBy("key", "context").agg(F.max("o").alias("l"), F.min("o").alias("o"))
        result = result.unionByName(wide.select("key", "context", "l", (length - F.col("o")).alias("r")))
    result = scratch.table(result, "sorted")
    scratch.drop("cuts", "pieces", "kinds", "hot")
    whole = contexts.where("n > 1").select("key", "context", F.col("left").cast("long").alias("l"), F.col("right").cast("long").alias("r"))
    known = scratch.table(whole.unionByName(result.join(whole, ["key", "context"], "left_anti")), "reach")
    scratch.drop("sorted", "contexts")
    spans = again.select("key", "context", "doc_id", "fp", "pos").join(known, ["key", "context"])
    span = F.struct(F.col("key").bitwiseAND(1).cast("int").alias("unit"), (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))
    spans = scratch.table(spans.groupBy("doc_id", "fp").agg(F.collect_set(span).alias("spans")), "spans")
    scratch.drop("candidates", "reach")
    return spans


def with_spans(docs: DataFrame, name: str, doc_id: str, text: str, units: tuple[Unit, ...]) -> DataFrame:
    """docs with a column of what to remove from each text (null: nothing)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("fp"), F.col(text).alias("text"))
    spans = repeated_spans(slim, scratch, units).withColumnRenamed("spans", name)
    same = docs[doc_id].cast("long").eqNullSafe(spans["doc_id"]) & (F.xxhash64(docs[text]) == spans["fp"])
    return docs.join(spans.hint("merge"), same, "left").select(docs["*"], spans[name])


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", units: tuple[Unit, ...] = BOTH) -> DataFrame:
    """One row per row of docs: doc_id, fp, n_bytes; of repeated bytes n_removed, n_spans, kept_sha256, kept (bytes); of repeated words n_passages, n_passage_words."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    joined = with_spans(slim, "spans", "doc_id", "text", units)
    return joined.select("doc_id", "text", "spans", F.xxhash64("text").alias("fp")).mapInArrow(_removed, RESULT)


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(text, found):
        if found is None or text is None:
            return text
        raw = text.encode()
        raw = without(raw, word_runs(raw, found))
        return raw.decode("utf-8", "ignore")

    return pd.Series([cut(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def without_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every passage of ``WORDS.length`` words or more that is found anywhere else cut out of the texts."""
    name = unused(docs, "spans")
    return with_spans(docs, name, doc_id, text, (WORDS,)).withColumn(text, F.pandas_udf(_without, "string")(F.col(text), F.col(name))).drop(name)
