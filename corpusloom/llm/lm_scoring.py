"""Language-model scores of whole texts: word counts and a gated recurrent network.

1. Words of the training texts are counted: summed in each task, then shuffled.
2. The most frequent words are *learned words* of the network; every other word
   has a *spelling class* (its last letters), inside which it has the share that
   the counts give it.  An unseen word gets the share that smoothing leaves.
3. All training texts are learned from, in ``len(ROUNDS)`` rounds.  Texts are dealt
   to replicas by hash, one replica to about ``UNIT`` tokens of the round, so what
   is learned depends on the texts and not on how the table is split.  In a round
   every replica starts from the same weights, runs truncated backpropagation over
   its texts, and the replicas are averaged on the executors, weighted by tokens.
   There are at most ``REPLICAS`` of them; beyond that each takes more tokens.
4. All texts are scored whole; the state is carried across windows.  A table of
   the ``TOP`` most frequent words' counts (some 20 bytes each) is broadcast; the
   counts of rarer words are joined by a shuffle and added to the scores.

A text's tokens are its words, lower-cased in A-Z, then one end token.  Scores
are log10 probabilities.  Null texts are empty and have the end token only; a
null id is held out; equal rows give equal results; extra columns are ignored;
an empty table gives no rows, and without training texts every word is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.llm.gru import BLOCK, Gru, Trainer, text_scores
from corpusloom.llm.scratch import Scratch

BLOCKS, CLASSES, TOP = 32, 32, 1 << 17
#: Sixteenths of the training texts learned from in each round, and the rates.
ROUNDS, RATES = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16)), (0.02, 0.015, 0.012, 0.008, 0.005)
#: Tokens to a replica, and replicas in all rounds (half a megabyte each where they are averaged).
UNIT, REPLICAS = 1_000_000, 1 << 16
#: Tokens that are learned from, and scored, at a time, whole texts together.
LEARNED, POOL = 1_000_000, 2_000_000
#: Rows of words counted before they are merged, and the pieces that weights are averaged in.
MERGE, PIECES, BUCKETS, PARTITIONS = 2_000_000, 64, 256, 1 << 14
END = np.uint64(0xE17D)
SMOOTH = 0.1


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, spelling classes, offsets by text) of slices of whole texts."""
    for a, b, raw, offsets in kernel.text_slices(column):
        folded = kernel.SPACED[raw]
        starts, ends, by_text = kernel.words(raw, offsets, kernel.SPACED)
        h = kernel.span_hash(kernel.running(folded), starts, ends)
        tail = np.zeros(len(starts), np.uint64)
        for back in (1, 2, 3):
            tail = tail << np.uint64(8) | np.where(ends - back >= starts, folded[np.maximum(ends - back, 0)], 0).astype(np.uint64)
        kind = (kernel.mix(tail) % np.uint64(CLASSES)).astype(np.int32)
        at = by_text[1:]
        yield a, b, np.insert(h, at, END), np.insert(kind, at, 0), by_text + np.arange(len(by_text))


def is_training(doc_id, parts: int = 10):
    """Which rows are learned from: crc32 of the id as text isn't a multiple of ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % parts != 0


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
    words, first, back = np.unique(h, return_index=True, return_inverse=True)
    return words, kind[first], np.bincount(back, n, len(words)).astype(np.int64)


def _counted(batches):
    held: list = []
    size = 0
    done = lambda x: pa.RecordBatch.from_arrays([pa.array(kernel.as_long(x[0])), pa.array(x[1], pa.int32()), pa.array(x[2])], ["h", "kind", "n"])
    for batch in batches:
        for _, _, h, kind, _ in tokens(batch.column(0)):
            held.append(_merged([(h, kind, np.ones(len(h), np.int64))]))
            size += len(held[-1][0])
            if size > MERGE:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > MERGE // 2:
                    yield done(held[0])
                    held, size = [], 0
    if held:
        yield done(_merged(held))


class Lexicon:
    """What tasks know of the words: counts of the most frequent, ids of the learned, sums of the rest."""

    def __init__(self, total: int, distinct: int, top: pa.Table, by_class: dict[int, tuple[int, int]]):
        """top: h, kind, n by falling n; by_class: (tokens, distinct words) of each spelling class."""
        self.total, self.distinct = total, distinct
        h = top["h"].to_numpy().view(np.uint64)
        kind, n = top["kind"].to_numpy(), top["n"].to_numpy()
        learned = min(len(h), BLOCKS * BLOCK)
        ids = np.concatenate([np.arange(learned), BLOCKS * BLOCK + kind[learned:]]).astype(np.int32)
        self.rest_n, self.rest_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (tokens_, words) in by_class.items():
            self.rest_n[k], self.rest_v[k] = tokens_, words
        self.rest_n -= np.bincount(kind[:learned], n[:learned], CLASSES)
        self.rest_v -= np.bincount(kind[:learned], minlength=CLASSES)
        self.learned_n = n[:learned].astype(np.float64)
        order = np.argsort(h, kind="stable")
        self.h, self.n, self.ids = h[order], n[order].astype(np.float64), ids[order]
        self.base_low = np.log10(total + SMOOTH * (distinct + 1))
        self.class_low = np.log10(self.rest_n + SMOOTH * (self.rest_v + 1))
        self.end = int(self.look(np.array([END]), np.zeros(1, np.int32))[0][0])

    def look(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model id, count or -1 where the table lacks the word) of each token."""
        ids, n = BLOCKS * BLOCK + kind, np.full(len(h), -1.0)
        if len(self.h):
            at = np.searchsorted(self.h, h)
            at[at == len(self.h)] = 0
            known = self.h[at] == h
            n[known] = self.n[at[known]]
            ids = np.where(known, self.ids[at], ids)
        return ids.astype(np.int32), n


def _pools(batches, column: int, most: int):
    """(first rows' batch parts, hashes, classes, offsets) of about ``most`` tokens of whole texts."""
    rows, hashes, kinds, lengths, size = [], [], [], [], 0
    out = lambda: (rows, np.concatenate(hashes), np.concatenate(kinds), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))
    for batch in batches:
        for a, b, h, kind, offsets in tokens(batch.column(column)):
            rows.append(batch.slice(a, b - a))
            hashes.append(h)
            kinds.append(kind)
            lengths.append(np.diff(offsets))
            size += len(h)
            if size >= most:
                yield out()
                rows, hashes, kinds, lengths, size = [], [], [], [], 0
    if rows:
        yield out()


def _by_replica(batches):
    """(replica, its batches) of batches (replica, text) sorted by replica."""

    def runs():
        for batch in batches:
            replica = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(replica)) + 1).tolist(), len(replica)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    yield int(replica[a]), batch.slice(a, b - a)

    for replica, parts in groupby(runs(), key=itemgetter(0)):
        yield replica, (part for _, part in parts)


def _trained(batches, lexicon: Lexicon, flat: np.ndarray, rate: float):
    for replica, own in _by_replica(batches):
        trainer = Trainer(Gru(BLOCKS, CLASSES, flat), rate)
        seen = 0
        for _, h, kind, offsets in _pools(own, 1, LEARNED):
            ids, _ = lexicon.look(h, kind)
            first = np.zeros(len(ids), bool)
            first[offsets[:-1]] = True
            trainer.learn(ids, first, lexicon.end)
            seen += len(ids)
        for i, piece in enumerate(np.array_split(trainer.model.flat.astype(np.float64) * seen, PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([replica], pa.int32()), pa.array([float(seen)]), pa.array([piece.tobytes()], pa.binary())], ["piece", "task", "seen", "sums"])


def _added(batches):
    """Sums of the rows that follow one another with the same piece."""
    key, task, seen, sums = None, 0, 0.0, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([task], pa.int32()), pa.array([seen]), pa.array([sums.tobytes()], pa.binary())], ["piece", "task", "seen", "sums"])
    for batch in batches:
        for piece, t, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece != key:
                if sums is not None:
                    yield row()
                key, task, seen, sums = piece, t, 0.0, 0.0
            seen, sums = seen + n, sums + np.frombuffer(raw)
    if sums is not None:
        yield row()


def averaged(replicas: DataFrame) -> np.ndarray | None:
    """The mean of all replicas, added up on the executors in two steps; the driver gets one model."""
    schema = "piece int, task int, seen double, sums binary"
    some = replicas.withColumn("bucket", F.col("task") % BUCKETS).repartition("piece", "bucket").sortWithinPartitions("piece", "task").drop("bucket").mapInArrow(_added, schema)
    rows = some.repartition("piece").sortWithinPartitions("piece", "task").mapInArrow(_added, schema).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r.sums) / r.seen for r in sorted(rows, key=lambda r: r.piece)]).astype(np.float32)


def _scored(batches, lexicon: Lexicon, flat: np.ndarray):
    model, log10 = Gru(BLOCKS, CLASSES, flat), np.log(10)
    for rows, h, kind, offsets in _pools(batches, 2, POOL):
        ids, n = lexicon.look(h, kind)
        net = text_scores(model, ids, offsets, lexicon.end) / log10
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        missing, texts = n < 0, len(offsets) - 1
        known = np.log10(np.where(missing, 1.0, n + SMOOTH))
        base = np.bincount(owner, known, texts) - np.diff(offsets) * lexicon.base_low
        inner = np.where(ids >= model.words, known - lexicon.class_low[np.maximum(ids - model.words, 0)], 0.0)
        score = net + np.bincount(owner, inner, texts)
        found = np.bincount(owner, ~missing, texts).astype(np.int64)
        rare, whose = h[missing], owner[missing]
        by = np.lexsort((rare, whose))
        rare, whose = rare[by], whose[by]
        fresh = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (whose[1:] != whose[:-1])]) if len(rare) else np.zeros(0, bool))
        times = np.diff(np.append(fresh, len(rare)))
        bounds = np.searchsorted(whose[fresh], np.arange(texts + 1)).astype(np.int32)
        ids_ = pa.concat_arrays([r.column(0) for r in rows]), pa.concat_arrays([r.column(1) for r in rows])
        for a in range(0, texts, 2000):
            z = min(a + 2000, texts)
            x, y = bounds[a], bounds[z]
            lists = lambda v, a=a, z=z, x=x: pa.ListArray.from_arrays(pa.array(bounds[a : z + 1] - x), v)
            yield pa.RecordBatch.from_arrays(
                [
                    ids_[0].slice(a, z - a),
                    ids_[1].slice(a, z - a),
                    pa.array(np.diff(offsets)[a:z]),
                    pa.array(found[a:z]),
                    pa.array(base[a:z]),
                    pa.array(score[a:z]),
                    lists(pa.array(kernel.as_long(rare[fresh[x:y]]))),
                    lists(pa.array(times[x:y].astype(np.int32))),
                ],
                ["doc_id", "held_out", "n_tokens", "found", "base", "score", "rare", "times"],
            )


def scored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    own = F.col(doc_id)
    training = docs.where(is_training(own)).select(F.col(text).alias("text"), F.pmod(F.xxhash64(own.cast("string"), F.col(text)), F.lit(16)).alias("share"), F.xxhash64(F.col(text), own.cast("string")).alias("deal"))
    counts = training.select("text").mapInArrow(_counted, "h long, kind int, n long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    counts = scratch.table(counts, "counts")
    by_class = {r.kind: (r.n, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    top = counts.orderBy(F.desc("n"), "h").limit(TOP).toArrow()
    total, distinct = (sum(x[i] for x in by_class.values()) for i in (0, 1))
    lexicon = Lexicon(total, distinct, top, by_class)
    held = spark.sparkContext.broadcast(lexicon)
    flat = Gru(BLOCKS, CLASSES).start(lexicon.learned_n, lexicon.rest_n).flat
    unit = max(UNIT, total // REPLICAS)
    for (low, high), rate in zip(ROUNDS, RATES, strict=True):
        replicas = max(1, round(total * (high - low) / 16 / unit))
        share = training.where((F.col("share") >= low) & (F.col("share") < high)).select(F.pmod(F.col("deal"), F.lit(replicas)).cast("int").alias("replica"), "text", "deal")
        dealt = share.repartition(min(replicas, PARTITIONS), "replica").sortWithinPartitions("replica", "deal").select("replica", "text")
        weights = spark.sparkContext.broadcast(flat)
        found = averaged(dealt.mapInArrow(lambda batches, w=weights, r=rate: _trained(batches, held.value, w.value, r), "piece int, task int, seen double, sums binary"))
        flat = flat if found is None else found
    weights = spark.sparkContext.broadcast(flat)
    source = docs.select(own.cast("long").alias("doc_id"), (~is_training(own)).alias("held_out"), F.col(text).alias("text"))
    schema = "doc_id long, held_out boolean, n_tokens long, found long, base double, score double, rare array<long>, times array<int>"
    first = source.mapInArrow(lambda batches: _scored(batches, held.value, weights.value), schema)
    first = scratch.table(first.withColumn("row", F.monotonically_increasing_id()), "first")
    asked = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    least = top["n"][-1].as_py() if len(top) else 0  # no word that the table lacks has a higher count
    rest = counts.where(F.col("n") <= least).select("h", "n")
    seen = asked.join(rest, "h", "left")
    added = seen.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    more = F.coalesce("more", F.lit(0.0))
    return first.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("found") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
