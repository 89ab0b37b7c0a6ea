"""Ranked lexical search over dual-sorted wavelet trees, one per shard of documents.

A task turns its documents into shards as it reads them, without a shuffle.  In a
shard all postings lie in one sequence of local document numbers, a term's postings
together and ordered by impact, the highest first.  The sequence is kept as a
wavelet matrix: level by level the bits of the document numbers, each level a stable
partition of the one before.  So a node of the tree is a range of documents, the
postings of a term inside it are a span, and, as order is kept, the first of them
has the term's highest impact there.

A search starts at the root with the spans of an item's terms.  The bound of a node
is the sum of weight times highest impact; nodes are opened best first, in batches
over many items, their spans carried into both halves by rank; what can't reach the
k-th best score (or reaches it at later documents only) is dropped.  At a leaf the
bound is the score.  A task keeps the best k of an item over all its shards, so later
shards are cut by what earlier ones found, and the result is exact.

The corpus' statistics (documents with a term, their terms) are taken in a first
pass, since impacts depend on them.  Items are read in blocks of ``BLOCK_TERMS`` terms, so the
broadcast is bounded; every block is searched in the whole index.

Terms are known by 64-bit hashes.  Null and empty texts have no terms: such documents
are never found, such items find none.  A null doc_id sorts first.  Repeated rows are
documents, or items, of their own; extra columns are ignored; empty tables give no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from corpusloom.llm import kernel
from corpusloom.llm.scratch import Scratch

#: A shard is closed with so many documents or so many words.
SHARD_DOCS, SHARD_WORDS = 1 << 12, 1 << 21
#: Terms of a block of items; postings of items that are searched together.
BLOCK_TERMS, TOGETHER = 1 << 20, 1 << 20
#: Nodes of an item that are opened at once until k documents are found; afterwards half of what is left.
OPENED = 64
TOP = 50
# Fixed values of the score.
SCALE, GROWTH, LENGTH, PLAIN = 1_000_000_000, 1000, 20, 50

INDEX = "n_docs int, n_postings int, ids binary, null_ids binary, terms binary, offsets binary, impacts binary, bits binary"


def _counted(batches):
    docs = terms = 0
    for batch in batches:
        for _, _, raw, offsets in kernel.text_slices(batch.column(0)):
            sizes = np.diff(kernel.words(raw, offsets, kernel.ALNUM)[2])
            docs += int((sizes > 0).sum())
            terms += int(sizes.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


class _Builder:
    """Collects the words of documents and makes a shard of them."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.start()

    def start(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.docs = self.words = 0

    def add(self, ids: np.ndarray, nulls: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.append(ids)
        self.nulls.append(nulls)
        self.hashes.append(hashes)
        self.sizes.append(sizes)
        self.docs += len(ids)
        self.words += len(hashes)

    def shard(self) -> pa.RecordBatch:
        ids, nulls, sizes, hashes = map(np.concatenate, (self.ids, self.nulls, self.sizes, self.hashes))
        self.start()
        number = np.empty(len(ids), np.int64)
        in_order = np.lexsort((ids, ~nulls))
        number[in_order] = np.arange(len(ids))
        doc = np.repeat(number, sizes)
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
        tf = np.diff(np.append(edge, len(doc)))
        hashes, doc = hashes[edge], doc[edge]
        by_number = np.empty(len(ids), np.int64)
        by_number[number] = sizes
        m = PLAIN + (PLAIN * by_number * self.n_docs) // max(1, self.n_terms)
        impact = (SCALE * tf) // (GROWTH * tf + LENGTH * m[doc])
        order = np.lexsort((-impact, hashes))  # stable: equal impacts by document
        hashes, doc, impact = hashes[order], doc[order], impact[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        values = [len(ids), len(doc), ids[in_order], np.packbits(nulls[in_order]), hashes[first], np.append(first, len(doc)).astype(np.int32), impact, _levels(doc, len(ids))]
        columns = [pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in (v if isinstance(v, int) else v.tobytes() for v in values)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])


def _depth(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def _levels(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The wavelet matrix of document numbers: a row of bits, in words of 64, per level."""
    depth, words = _depth(n_docs), len(doc) // 64 + 1
    out = np.zeros((depth, words * 8), np.uint8)
    for level in range(depth):
        bit = ((doc >> (depth - 1 - level)) & 1).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        out[level, : len(packed)] = packed
        doc = np.concatenate([doc[~bit], doc[bit]])
    return out


def _built(batches, n_docs: int, n_terms: int, shard_docs: int, shard_words: int):
    builder = _Builder(n_docs, n_terms)
    for batch in batches:
        keys = batch.column(0)
        nulls = np.asarray(keys.is_null())
        ids = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, _, raw, offsets in kernel.text_slices(batch.column(1)):
            hashes, by_text = kernel.word_hashes(raw, offsets, kernel.ALNUM)
            sizes = np.diff(by_text)
            a = 0
            while a < len(sizes):
                upto = int(np.searchsorted(by_text, by_text[a] + shard_words - builder.words, "right")) - 1
                b = min(max(a + 1, upto), a + shard_docs - builder.docs, len(sizes))
                builder.add(ids[first + a : first + b], nulls[first + a : first + b], hashes[by_text[a] : by_text[b]], sizes[a:b])
                a = b
                if builder.docs >= shard_docs or builder.words >= shard_words:
                    yield builder.shard()
    if builder.docs:
        yield builder.shard()


class Index:
    """The shards of a table of documents, and the statistics that their impacts were made with."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms


def build_index(
    docs: DataFrame,
    scratch: Scratch,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_docs: int = SHARD_DOCS,
    shard_words: int = SHARD_WORDS,
) -> Index:
    """Writes the shards of all documents."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.select("text").mapInArrow(_counted, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (int(x or 0) for x in total)
    made = rows.mapInArrow(lambda batches: _built(batches, n_docs, n_terms, shard_docs, shard_words), INDEX)
    return Index(scratch.table(made, "shards"), n_docs, n_terms)


class _Shard:
    """A shard as it is searched: bits with rank directories, and the impacts in the order of every level."""

    def __init__(self, row: dict):
        n, self.docs = row["n_postings"], row["n_docs"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[: self.docs].astype(bool)
        self.terms, self.offsets = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["offsets"], np.int32)
        self.depth = _depth(self.docs)
        self.words = np.frombuffer(row["bits"], np.uint64).reshape(self.depth, -1)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, axis=1, dtype=np.int32) - counts
        self.zeros = n - counts.sum(axis=1, dtype=np.int64)
        self.impacts = np.empty((self.depth + 1, n), np.int32)
        self.impacts[0] = np.frombuffer(row["impacts"], np.int32)
        for level in range(self.depth):
            bit = np.unpackbits(self.words[level].view(np.uint8), bitorder="little")[:n].astype(bool)
            self.impacts[level + 1, : self.zeros[level]] = self.impacts[level][~bit]
            self.impacts[level + 1, self.zeros[level] :] = self.impacts[level][bit]

    def rank(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ones the level has before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level, word] + np.bitwise_count(self.words[level, word] & mask)

    def spans(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each term's postings, equal where it has none."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return np.where(there, self.offsets[at], 0).astype(np.int64), np.where(there, self.offsets[at + 1], 0).astype(np.int64)


class _Best:
    """The k best documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)
        self.least = np.zeros(n_items, np.int64)  # a document has to reach it; one that just does must come before the last
        self.full = np.zeros(n_items, bool)
        self.last_id = np.zeros(n_items, np.int64)
        self.last_null = np.zeros(n_items, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, score, ids, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, ~null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.full[item[last]] = True
        self.least[item[last]], self.last_id[item[last]], self.last_null[item[last]] = score[last], ids[last], null[last]
        kept = place < self.k
        self.item, self.score, self.id, self.null = item[kept], score[kept], ids[kept], null[kept]

    def possible(self, item: np.ndarray, bound: np.ndarray, ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Whether documents from (null, id) on with scores up to the bounds could be among the best."""
        earlier = np.where(null == self.last_null[item], ids <= self.last_id[item], null)
        least = self.least[item]
        return (bound > 0) & (~self.full[item] | (bound > least) | (bound == least) & earlier)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class _Frontier:
    """Nodes that may be opened, each with the spans of its item's terms."""

    def __init__(self, item, level, prefix, bound, sizes, lo, hi, weight):
        self.item, self.level, self.prefix, self.bound, self.sizes = item, level, prefix, bound, sizes
        self.lo, self.hi, self.weight = lo, hi, weight

    def take(self, nodes: np.ndarray) -> _Frontier:
        starts = np.cumsum(self.sizes) - self.sizes
        at = _ragged(starts[nodes], self.sizes[nodes])
        return _Frontier(*(x[nodes] for x in (self.item, self.level, self.prefix, self.bound, self.sizes)), *(x[at] for x in (self.lo, self.hi, self.weight)))

    def plus(self, other: _Frontier) -> _Frontier:
        return _Frontier(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))

    def opened(self, shard: _Shard) -> _Frontier:
        """Both halves of every node, without those that no term reaches."""
        node = np.repeat(np.arange(len(self.item)), self.sizes)
        level = self.level[node]
        ones_lo, ones_hi = shard.rank(level, self.lo), shard.rank(level, self.hi)
        zeros = shard.zeros[level]
        lo = np.concatenate([self.lo - ones_lo, zeros + ones_lo])
        hi = np.concatenate([self.hi - ones_hi, zeros + ones_hi])
        child = np.concatenate([2 * node, 2 * node + 1])
        weight, below = np.concatenate([self.weight, self.weight]), np.concatenate([level, level]) + 1
        there = np.flatnonzero(hi > lo)
        there = there[np.argsort(child[there], kind="stable")]
        lo, hi, child, weight = lo[there], hi[there], child[there], weight[there]
        first = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]])) if len(child) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weight * shard.impacts[below[there], lo], first) if len(first) else np.zeros(0, np.int64)
        child = child[first]
        parent = child >> 1
        sizes = np.diff(np.append(first, len(lo)))
        return _Frontier(self.item[parent], self.level[parent] + 1, 2 * self.prefix[parent] + (child & 1), sums, sizes, lo, hi, weight)


def _search(shard: _Shard, frontier: _Frontier, best: _Best) -> None:
    def possible(f: _Frontier) -> np.ndarray:
        first = f.prefix << (shard.depth - f.level)
        return best.possible(f.item, f.bound, shard.ids[first], shard.nulls[first])

    while True:
        alive = np.flatnonzero(possible(frontier))
        if not len(alive):
            return
        order = alive[np.lexsort((frontier.prefix[alive] << (shard.depth - frontier.level[alive]), -frontier.bound[alive], frontier.item[alive]))]
        item = frontier.item[order]
        first, of_item, sizes = np.unique(item, return_index=True, return_counts=True)[0:3]
        place = np.arange(len(order)) - np.repeat(of_item, sizes)
        most = np.where(best.full[first], np.maximum(OPENED, (sizes + 1) // 2), OPENED)
        now = place < np.repeat(most, sizes)
        children = frontier.take(order[now]).opened(shard)
        leaf = children.level == shard.depth
        found = np.flatnonzero(leaf & possible(children))
        docs = children.prefix[found]
        best.add(children.item[found], children.bound[found], shard.ids[docs], shard.nulls[docs])
        frontier = frontier.take(order[~now]).plus(children.take(np.flatnonzero(~leaf)))


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items with so many postings together, or single ones."""
    a, upto = 0, np.cumsum(sizes)
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _searched(batches, items, k: int, kind: pa.DataType):
    ids, bounds, terms, weights = items.value
    best = _Best(len(ids), k)
    item_of = np.repeat(np.arange(len(ids)), np.diff(bounds))
    for batch in batches:
        for i in range(batch.num_rows):
            shard = _Shard(batch.slice(i, 1).to_pylist()[0])
            lo, hi = shard.spans(terms)
            useful = np.flatnonzero((hi > lo) & (weights > 0))
            item, lo, hi, weight = item_of[useful], lo[useful], hi[useful], weights[useful]
            held, first, counts = np.unique(item, return_index=True, return_counts=True)
            if not len(held):
                continue
            bound = np.add.reduceat(weight * shard.impacts[0][lo], first)
            for a, b in _groups(np.add.reduceat(hi - lo, first), TOGETHER):
                part = slice(first[a], first[a] + counts[a:b].sum())
                zero = np.zeros(b - a, np.int64)
                _search(shard, _Frontier(held[a:b], zero, zero.copy(), bound[a:b], counts[a:b], lo[part], hi[part], weight[part]), best)
    doc_ids = pa.array(best.id, pa.int64(), mask=best.null)
    yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array([ids[i] for i in best.item], kind), doc_ids, pa.array(best.score)], ["item", "item_id", "doc_id", "score"])


def _tokenised(batches, kind: pa.DataType):
    for batch in batches:
        terms: list[bytes] = []
        for _, _, raw, offsets in kernel.text_slices(batch.column(1)):
            hashes, by_text = kernel.word_hashes(raw, offsets, kernel.ALNUM)
            terms += [np.unique(hashes[a:b]).tobytes() for a, b in zip(by_text, by_text[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(terms, pa.binary())], ["item_id", "terms"])


def _frequencies(batches, wanted):
    terms = wanted.value
    found = np.zeros(len(terms), np.int64)
    for batch in batches:
        for there, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own, sizes = np.frombuffer(there, np.uint64), np.diff(np.frombuffer(offsets, np.int32))
            if len(own):
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                found += np.where(own[at] == terms, sizes[at], 0)
    held = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["term", "df"])


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    block, n = [], 0
    for row in items.toLocalIterator():
        block.append((row.item_id, np.frombuffer(row.terms, np.uint64)))
        n += len(block[-1][1])
        if n >= most:
            yield block
            block, n = [], 0
    if block:
        yield block


def search(
    index: Index,
    items: DataFrame,
    *,
    item_id: str = "item_id",
    text: str = "text",
    k: int = TOP,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0, equal scores by ascending id."""
    spark, kind = items.sparkSession, items.schema[item_id].dataType
    arrow = to_arrow_type(kind)
    with_terms = StructType([StructField("item_id", kind), StructField("terms", BinaryType())])
    tokens = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(lambda batches: _tokenised(batches, arrow), with_terms)
    found_as = StructType([StructField("item", LongType()), StructField("item_id", kind), StructField("doc_id", LongType()), StructField("score", LongType())])
    parts = []
    for block in _blocks(tokens, block_terms):
        ids, terms = [i for i, _ in block], np.concatenate([t for _, t in block])
        bounds = np.concatenate([[0], np.cumsum([len(t) for _, t in block])])
        distinct, which = np.unique(terms, return_inverse=True)
        wanted = spark.sparkContext.broadcast(distinct)
        df = np.zeros(len(distinct), np.int64)
        counted = index.shards.select("terms", "offsets").mapInArrow(lambda batches, wanted=wanted: _frequencies(batches, wanted), "term long, df long")
        for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most a block's terms
            df[row.term] = row.df
        weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        held = spark.sparkContext.broadcast((ids, bounds, terms, weight[which]))
        best = index.shards.mapInArrow(lambda batches, held=held: _searched(batches, held, k, arrow), found_as)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))).cast(IntegerType())
        parts.append(best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], StructType([StructField("item_id", kind), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
