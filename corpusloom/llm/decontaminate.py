"""Benchmark decontamination by winnowing.

Words are compared lower-cased, over whole texts.  A *window* is ``span``
consecutive words of an item, or all words of a shorter item.  Of every
``span - k + 1`` neighbouring k-grams the one of least hash is a fingerprint, so
two texts that share a window share a fingerprint.  The items' fingerprints are
joined with the documents'; around each hit the windows that hold it are
compared in full, and the words of those that match are marked.  Items shorter
than ``span`` are fingerprinted whole, by their own length.

The benchmark is read in blocks of at most ``block_words`` words; each block's
tables are broadcast (some 30 bytes a word, so the bound is proven) and meets
all documents in one pass without a shuffle.  With one block, the usual case,
nothing else happens; with more, the hits are gathered by document.

Nulls, empty texts and texts without a word: no words, nothing hit.  A document
shorter than a window cannot hold it.  Repeated rows give repeated results.
Items without words are ignored; an item id that repeats counts once; a null
item id marks words but isn't listed.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import kernel

SPAN, K = 10, 5
BLOCK_WORDS = 2_000_000

RESULT = "doc_id long, n_words long, n_hit long, items array<string>, hits array<struct<first: long, end: long>>, row long"


class Windows:
    """Sorted fingerprints and windows of some items, with the items that hold each window."""

    def __init__(self, items: list[tuple[str | None, str]], span: int, k: int):
        self.span, self.k = span, k
        names = sorted({i for i, _ in items if i is not None})
        number = {name: j for j, name in enumerate(names)} | {None: -1}
        pairs: dict[int, list[tuple[np.ndarray, int]]] = {}
        prints = []
        for name, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            h, _ = kernel.word_hashes(raw, np.array([0, len(raw)]), kernel.ALNUM)
            if len(h):
                size = min(span, len(h))
                pairs.setdefault(size, []).append((kernel.gram_hashes(h, size), number[name]))
                if size == span:
                    prints.append(np.unique(kernel.window_minima(kernel.gram_hashes(h, k), span - k + 1)))
        self.names = names
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.by_size = {}
        for size, found in pairs.items():
            h = np.concatenate([x for x, _ in found])
            owner = np.concatenate([np.full(len(x), i, np.int64) for x, i in found])
            order = np.argsort(h, kind="stable")
            self.by_size[size] = (h[order], owner[order])


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _hits(h: np.ndarray, by_text: np.ndarray, w: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (window size, first words, hashes) of the windows that occur, over a slice of texts."""
    ends = by_text[1:]
    for size, (table, _) in w.by_size.items():
        if size == w.span:
            grams = kernel.gram_hashes(h, w.k)
            width = w.span - w.k + 1
            least = kernel.window_minima(grams, width)
            if not len(least):
                continue
            # a window's fingerprint hits, or the window can't occur in an item
            first = np.flatnonzero(_within(least, w.prints))
            found = kernel.gram_hashes(h, size)[first]
        else:
            found = kernel.gram_hashes(h, size)
            first = np.arange(len(found))
        good = _within(found, table)
        first, found = first[good], found[good]
        text = np.searchsorted(ends, first, "right")
        good = first + size <= ends[np.minimum(text, len(ends) - 1)]
        yield size, first[good], found[good]


def _scan(batches, w: Windows):
    for batch in batches:
        for a, b, raw, offsets in kernel.text_slices(batch.column(1)):
            h, by_text = kernel.word_hashes(raw, offsets, kernel.ALNUM)
            n = b - a
            cover = np.zeros(len(h) + 1, np.int64)
            items: dict[int, set[int]] = {}
            for size, first, found in _hits(h, by_text, w):
                np.add.at(cover, first, 1)
                np.add.at(cover, first + size, -1)
                table, owner = w.by_size[size]
                text = np.searchsorted(by_text[1:], first, "right")
                lo, hi = np.searchsorted(table, found), np.searchsorted(table, found, "right")
                for t, x, y in set(zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)):
                    items.setdefault(t, set()).update(owner[x:y].tolist())
            hit = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[by_text[1:]] - total[by_text[:-1]]
            listed = [sorted(w.names[i] for i in items.get(t, ()) if i >= 0) for t in range(n)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            if hit.any():
                cut = np.zeros(len(hit) + 1, bool)
                cut[by_text] = True
                edge = np.concatenate([[False], hit, [False]])
                starts = np.flatnonzero(hit & (~edge[:-2] | cut[:-1]))
                stops = np.flatnonzero(hit & (~edge[2:] | cut[1:])) + 1
                for t, x, y in zip(np.searchsorted(by_text[1:], starts, "right"), starts, stops, strict=True):
                    spans[t].append({"first": int(x - by_text[t]), "end": int(y - by_text[t])})
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, n),
                    pa.array(np.diff(by_text)),
                    pa.array(n_hit),
                    pa.array(listed, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    batch.column(2).slice(a, n),
                ],
                ["doc_id", "n_words", "n_hit", "items", "hits", "row"],
            )


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str | None, str]]]:
    block, size = [], 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where(F.length("t") > 0)
    for row in rows.toLocalIterator():
        n = len(row.t) // 2 + 1
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += n
    yield block


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    k: int = K,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids as strings), hits (word spans)."""
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = source.withColumn("row", F.xxhash64("text"))
    parts = []
    for block in _blocks(items, item_id, item_text, block_words):
        held = spark.sparkContext.broadcast(Windows(block, span, k))
        parts.append(source.mapInArrow(lambda batches, held=held: _scan(batches, held.value), RESULT))
    if len(parts) == 1:
        return parts[0].drop("row")
    # Several blocks: each row's hits from every block meet again.  Copies of a row give equal hits, so a row
    # count restores them.
    every = parts[0].withColumn("block", F.lit(0))
    for b, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("block", F.lit(b)))
    merged = every.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("spans"),
        F.count(F.when(F.col("block") == 0, 1)).alias("copies"),
    )
    start = F.struct(F.array().cast("array<struct<first:bigint,end:bigint>>").alias("done"), F.lit(None).cast("struct<first:bigint,end:bigint>").alias("last"))
    joined = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.when(acc["last"].isNull(), F.struct(acc["done"].alias("done"), x.alias("last")))
        .when(
            x["first"] <= acc["last"]["end"],
            F.struct(acc["done"].alias("done"), F.struct(acc["last"]["first"].alias("first"), F.greatest(acc["last"]["end"], x["end"]).alias("end")).alias("last")),
        )
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["last"])).alias("done"), x.alias("last"))),
        lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))),
    )
    return (
        merged.withColumn("hits", joined)
        .withColumn("n_hit", F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"]), F.lit(0)))
        .withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "n_words", "n_hit", "items", "hits")
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _cleanness(held):
    """A function from texts to whether no window of the broadcast block occurs in them."""

    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        for a, _, raw, offsets in kernel.text_slices(texts):
            h, by_text = kernel.word_hashes(raw, offsets, kernel.ALNUM)
            for _, first, _ in _hits(h, by_text, held.value):
                out[a + np.searchsorted(by_text[1:], first, "right")] = False
        return pa.array(out)

    return clean


def uncontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    for block in _blocks(items, item_id, item_text, block_words):
        held = docs.sparkSession.sparkContext.broadcast(Windows(block, span, k))
        docs = docs.where(F.arrow_udf(_cleanness(held), "boolean")(F.col(text)))
    return docs
