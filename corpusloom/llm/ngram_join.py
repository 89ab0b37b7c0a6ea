"""Similarity join on word shingles: T-occurrence search with DivideSkip.

A text's set is its distinct 5-word shingles (its whole word sequence where it
has fewer words), each known by 64 bits.  Texts link when their sets have a
Jaccard similarity of at least ``num/den``.

1. Shingles have a global order: first the *counted* quarter of all shingles (by
   hash) from rare to frequent, then the rest by hash, last those that a sample
   shows to be very frequent.  Two linked sets share one of the
   ``n - ceil(t n) + 1`` shingles that come first in each, the *prefix*.
2. Equal sets become one node.  A task sends a set once, so a large group of
   copies costs a row per task and shingle.  The counted shingles are shuffled; a
   shingle that only one node has can't link, and as rare ones come first, most
   texts have a prefix of such and are settled here.
3. Sets are *banded* by size, so that linked ones lie in one band or two that adjoin.
   Nodes that share a prefix shingle and a band are tied to the least of them, and
   the least ones of adjoining bands to each other: a row per node, no pairs.  The
   components of these candidate edges are split into groups that fit a task.
4. In each group every set searches the inverted lists of the smaller sets, by spans
   of sets, the nearest in size first (DivideSkip): the longest lists are set aside,
   the short ones merged by a heap, and what occurs often enough there is probed in
   the long ones by binary search.  A span of which all sets are in the component
   already is passed over.
   A candidate component over ``block`` shingles is cut into blocks by band and hash;
   blocks meet where their bands may link, so no task holds more than two.
5. Links within groups are merged into components, known by their least doc_id.

Nulls and texts without words: empty sets, linked with nothing, a component of
their own.  A row with a null id has its group's least id, or null.  Equal rows are one component.  Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.llm.components import connected_components
from corpusloom.llm.scratch import Scratch

SIZE, NUM, DEN = 5, 4, 5
BLOCK = 2_000_000
#: Shingles below this (a quarter of them) are counted exactly.
COUNTED = np.uint64(1 << 62)
#: One text in SAMPLE shows which shingles are frequent; at most FREQUENT of them (16 bytes each) are broadcast.
SAMPLE, FREQUENT, OFTEN = 64, 500_000, 3
#: Row ids are broadcast to find their texts up to this count (some 40 bytes each), beyond it they are shuffled.
BROADCAST_ROWS = 250_000
SEEN = 200_000


def text_sets(column: pa.Array, size: int = SIZE):
    """Yields (first row, list of sorted shingle sets) by slices of whole texts."""
    for a, b, raw, offsets in kernel.text_slices(column):
        h, by_text = kernel.word_hashes(raw, offsets, kernel.SPACED)
        grams = kernel.gram_hashes(h, size)
        sets = []
        for i in range(b - a):
            x, y = by_text[i], by_text[i + 1]
            if y - x >= size:
                sets.append(np.unique(grams[x : y - size + 1]))
            else:
                sets.append(kernel.gram_hashes(h[x:y], y - x) if y > x else grams[:0])
        yield a, sets


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(kernel.mix(np.array([kernel.mix(s ^ np.uint64(0x51ED270B)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def ordered(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[int, np.ndarray, np.ndarray]:
    """(length of the prefix, counted shingles, what follows them in a prefix that has room)."""
    n = len(s)
    keep = n - -(-num * n // den) + 1
    rare, common = s, s[:0]
    if len(frequent):
        at = np.searchsorted(frequent, s)
        at[at == len(frequent)] = 0
        known = frequent[at] == s
        rare, common, often = s[~known], s[known], counts[at[known]]
        common = common[np.lexsort((common, often))]
    few = int(np.searchsorted(rare, COUNTED))
    return keep, rare[:few], np.concatenate([rare[few:], common])[: max(0, keep - few)]


SETS = "doc_id long, fp long, n long, node long, keep long, counted array<long>, rest array<long>"


def _sets(batches, held):
    frequent, counts = held.value
    seen: set[int] = set()
    names = [x.split()[0] for x in SETS.split(", ")]
    longs = lambda x: pa.array(x, pa.list_(pa.int64()))
    for batch in batches:
        for a, sets in text_sets(batch.column(2)):
            nodes = [set_hash(s) if len(s) else None for s in sets]
            keep, counted, rest = [], [], []
            for node, s in zip(nodes, sets, strict=True):
                if node is None or node in seen:
                    found = None, None, None
                else:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    k, x, y = ordered(s, frequent, counts)
                    found = k, kernel.as_long(x), kernel.as_long(y)
                for to, value in zip((keep, counted, rest), found, strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, len(sets)), batch.column(1).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(keep, pa.int64()), longs(counted), longs(rest)], names
            )


def _all_shingles(batches):
    for batch in batches:
        for _, sets in text_sets(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(kernel.as_long(np.concatenate(sets)))], ["g"])


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) that occur often in a sample of the texts; decides an order only."""
    sample = docs.where(F.pmod("fp", F.lit(SAMPLE)) == 0).select("text")
    rows = sample.mapInArrow(_all_shingles, "g long").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = rows.orderBy(F.desc("n"), "g").limit(FREQUENT).toPandas()
    g, n = found["g"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(g)
    return g[order], n[order]


#: Members of short lists up to which a heap merges them; beyond it a sort that merges sorted runs does.
HEAPED = 512


def merged_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(members, how many of the sorted lists hold each)."""
    total = sum(map(len, lists))
    if total > HEAPED:
        every = np.sort(np.concatenate(lists), kind="stable")
    else:
        every = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64, total)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if total else np.zeros(0, np.int64)
    return every[first], np.diff(np.append(first, total))


#: Sets in the first span that a set searches; each further span is so many times as long.
SPAN, WIDER = 32, 8


class _Forest:
    """Union-find whose roots are the least members, with paths halved; roots of whole arrays at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return int(a)

    def roots(self, of: np.ndarray) -> np.ndarray:
        at = self.parent[of]
        while not np.array_equal(beyond := self.parent[at], at):
            self.parent[of] = at = beyond
        return at

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a


def linked(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> np.ndarray:
    """For each set the first set of its component, linked at num/den.

    A shingle that one set alone has counts in its size only.  Sets of one size that are
    equal but for such shingles have the same links to all others, so they are searched as one
    *class*: texts of one template with their own values cost no more than one of them.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, which, often = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared, at = often[which] > 1, np.concatenate([[0], np.cumsum(sizes)])
    numbers: dict[tuple[int, bytes], int] = {}
    of_set = np.empty(len(sets), np.int64)
    grams: list[np.ndarray] = []
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        own = which[a:b][shared[a:b]]
        of_set[i] = numbers.setdefault((b - a, own.tobytes()), len(numbers))
        if of_set[i] == len(grams):
            grams.append(own)
    n = np.array([size for size, _ in numbers], np.int64)
    order = np.argsort(n, kind="stable")
    of_class = np.empty(len(order), np.int64)
    of_class[order] = _search([grams[i] for i in order], n[order], num, den)
    group = of_class[of_set]
    alone = np.bincount(of_class, minlength=len(order))[group] == 1
    within = (num + den) * np.array([len(g) for g in grams], np.int64)[of_set] >= 2 * num * sizes if sets else np.zeros(0, bool)
    lead = np.full(len(order), len(sets), np.int64)
    np.minimum.at(lead, group, np.arange(len(sets)))
    return np.where(alone & ~within, np.arange(len(sets)), lead[group]) if sets else group


def _search(sets: list[np.ndarray], n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The component of each set, by T-occurrence search; n: the sets' sizes, ascending, with what only they have."""
    held = np.array([len(s) for s in sets], np.int64)
    forest = _Forest(len(sets))
    grams = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), held)
    by = np.lexsort((owner, grams))
    lists = owner[by]  # inverted lists, one after another, each by size of set
    keys = grams[by] * len(sets) + lists  # ascending: where a list's part from any set on begins is one look-up
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    first = np.concatenate([[0], np.cumsum(held)])

    def search(q: int, ends: np.ndarray, starts: np.ndarray, least: int, apart: np.ndarray) -> None:
        """Joins q with those of ``apart`` that hold enough of its shingles, ``least`` or more, in the lists' parts starts to ends."""
        lengths = ends - starts
        by_length = np.argsort(lengths, kind="stable")
        probe = 0.3 * np.log2(int(lengths[by_length[-1]]) + 2)
        aside = np.arange(min(least - 1, len(lengths)) + 1)  # how many of the longest lists are only probed
        merged = np.concatenate([[0], np.cumsum(lengths[by_length])])[len(lengths) - aside]
        cost = merged * (1 + probe * aside / (least - aside))
        chosen = int(cost.argmin())
        if probe * len(apart) * len(lengths) < cost[chosen]:  # few sets are left: all lists are probed for them
            found, k, long = apart, np.zeros(len(apart), np.int64), by_length
        else:
            short, long = by_length[: len(lengths) - chosen], by_length[len(lengths) - chosen :]
            found, k = merged_counts([lists[starts[i] : ends[i]] for i in short])
            found, k = found[k >= least - chosen], k[k >= least - chosen]
            other = forest.roots(found) != forest.root(q)
            found, k = found[other], k[other]
        enough = -(-num * (n[q] + n[found]) // (num + den))
        for left, i in zip(range(len(long), 0, -1), long, strict=True):
            open_ = np.flatnonzero((k < enough) & (k + left >= enough))
            if not len(open_):
                break
            part = lists[starts[i] : ends[i]]
            there = np.minimum(np.searchsorted(part, found[open_]), len(part) - 1)
            k[open_] += part[there] == found[open_]
        for c in found[k >= enough]:
            forest.join(q, int(c))

    for q in range(len(sets)):
        high, span = q, SPAN
        apart = np.arange(int(np.searchsorted(n, -(-num * int(n[q]) // den))), q)
        ends = place[first[q] : first[q + 1]]  # each list's part before q holds the sets searched
        own = grams[first[q] : first[q + 1]] * len(sets)
        while len(ends) and len(apart := apart[forest.roots(apart) != forest.root(q)]):
            low = max(int(apart[0]), high - span)
            here = apart[np.searchsorted(apart, low) :]
            least = -(-num * int(n[q] + n[low]) // (num + den))
            starts = np.searchsorted(keys, own + low)
            use = ends > starts
            if len(here) and int(use.sum()) >= least:
                search(q, ends[use], starts[use], least, here)
            apart, ends, high, span = apart[: len(apart) - len(here)], starts, low, WIDER * span
    return forest.roots(np.arange(len(sets)))


def _once(batches):
    """Rows without those whose node came before in the task; rows that are repeated in docs stand for one node."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for node in batch.column(2).to_pylist():
            fresh.append(node not in seen)
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
        yield batch if all(fresh) else batch.filter(pa.array(fresh))


def _searched(batches):
    """(component, node, lead) of each group's nodes, sorted by group and node; of equal nodes one is searched."""

    def rows():
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keys = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                for first, sets in text_sets(part.column(4)):
                    yield from zip(keys[first : first + len(sets)], sets, strict=True)

    out: tuple[list, list, list] = ([], [], [])
    for (component, _, _), members in groupby(rows(), key=lambda r: r[0][:3]):
        members = [next(same) for _, same in groupby(members, key=lambda r: r[0][3])]
        lead = linked([s for _, s in members]).tolist()
        for i, (key, _) in enumerate(members):
            out[0].append(component)
            out[1].append(key[3])
            out[2].append(members[lead[i]][0][3])
        if len(out[0]) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["component", "node", "lead"])
            out = ([], [], [])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["component", "node", "lead"])


def prefixes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n, g): the prefix shingles that more than one node can have."""
    nodes = sets.where(F.col("keep").isNotNull())
    grams = nodes.select("node", F.explode("counted").alias("g"))
    shared = grams.groupBy("g").agg(F.count("*").alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("g", "df")
    shared = scratch.table(shared, "shared")
    again = grams.join(shared, "g").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "g"))).alias("again"))
    each = nodes.groupBy("node").agg(F.min(F.struct("n", "keep", F.size("counted").alias("counted"), "rest")).alias("x")).select("node", "x.*")
    room = F.col("keep") - (F.col("counted") - F.coalesce(F.size("again"), F.lit(0)))
    first = F.when(F.col("again").isNotNull() & (room > 0), F.slice("again.g", F.lit(1), room.cast("int"))).otherwise(F.array().cast("array<long>"))
    return each.join(again, "node", "left").select("node", "n", F.explode(F.concat(first, "rest")).alias("g"))


def band(n, num: int = NUM, den: int = DEN):
    """Sizes that may link lie in one band or two that adjoin; a little wider than the ratio, for rounding."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num * 1.0001))).cast("long")


def candidate_edges(posts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): nodes tied to the least one of their band that shares a prefix shingle, and those of adjoining bands."""
    posts = scratch.table(posts.select("node", "g", band(F.col("n")).alias("band")), "posts")
    leads = scratch.table(posts.groupBy("g", "band").agg(F.min("node").alias("lead")), "leads")
    within = posts.join(leads, ["g", "band"]).where(F.col("lead") != F.col("node")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    above = leads.select("g", (F.col("band") - 1).alias("band"), F.col("lead").alias("above"))
    across = leads.join(above, ["g", "band"]).where(F.col("lead") != F.col("above")).select(F.col("lead").alias("a"), F.col("above").alias("b"))
    return within.unionByName(across).distinct()


def text_join(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, fp, ...) with each row's text; wanted is broadcast only if it is small."""
    small = wanted.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(wanted) if small else wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["fp"] == wanted["fp"])).select(wanted["*"], docs["text"])


def similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fp (hash of the text), n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "similar")
    found = labelled(docs, doc_id=doc_id, text=text, block=block)
    least = scratch.table(found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    return found.join(least, "label", "left").select("doc_id", "fp", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def labelled(docs: DataFrame, *, doc_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fp, n, label of its component (null: an empty set)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("fp"), F.col(text).alias("text"))
    held = spark.sparkContext.broadcast(frequent_shingles(docs))
    sets = scratch.table(docs.mapInArrow(lambda batches: _sets(batches, held), SETS), "sets")
    edges = scratch.table(candidate_edges(prefixes(sets, scratch), scratch), "candidates")
    scratch.drop("shared", "posts", "leads")
    groups = connected_components(edges, scratch, "groups")
    # One text stands for each node; a large group of copies is one row before anything is joined.
    rows = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "fp", "n")).alias("r")).join(groups, "node")
    nodes = scratch.table(rows.select("node", "component", "r.n", "r.doc_id", "r.fp"), "nodes")
    nodes = nodes.withColumn("band", band(F.col("n")))
    parts = nodes.groupBy("component", "band").agg(F.sum("n").alias("n"))
    parts = parts.groupBy("component").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / block).alias("parts")))).alias("parts"))  # a few bands
    sizes = scratch.table(parts.select("component", "parts", (F.col("total") > block).alias("large")), "sizes")
    # A block is a band and a part of it; those of a band meet each other and those of the bands beside it.
    part = lambda b, i: b * (1 << 32) + i
    own = part(F.col("band"), F.pmod(F.xxhash64("node"), F.element_at("parts", F.col("band"))))
    beside = F.flatten(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.transform(F.sequence(F.lit(1).cast("long"), F.coalesce(F.try_element_at("parts", b), F.lit(0).cast("long"))), lambda i: F.when(F.array_contains(F.map_keys("parts"), b), part(b, i - 1)))))
    wanted = nodes.join(sizes, "component")
    wanted = wanted.select("doc_id", "fp", "node", "component", "large", F.when(F.col("large"), own).otherwise(0).alias("own"), F.when(F.col("large"), F.array_compact(beside)).otherwise(F.array(F.lit(0).cast("long"))).alias("others"))
    wanted = scratch.table(wanted, "wanted")
    dealt = text_join(docs, wanted).select("component", "own", "node", "others", "text")
    dealt = dealt.mapInArrow(_once, dealt.schema).select("component", "own", "node", "text", F.explode("others").alias("other"))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "text")
    dealt = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "node")
    found = scratch.table(dealt.mapInArrow(_searched, "component long, node long, lead long"), "links")
    large = scratch.table(sizes.where("large").select("component"), "large")
    if large.limit(1).count():
        links = found.join(large, "component", "left_semi").where(F.col("node") != F.col("lead")).select(F.col("node").alias("a"), F.col("lead").alias("b"))
        whole = connected_components(links, scratch, "large-parts").select("node", F.col("component").alias("label"))
        labels = found.join(large, "component", "left_anti").select("node", F.col("lead").alias("label")).unionByName(whole)
    else:
        labels = found.select("node", F.col("lead").alias("label"))
    slim = sets.select("doc_id", "fp", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    slim = scratch.table(slim.select("doc_id", "fp", "n", "label"), "labels")
    scratch.drop("candidates", "wanted", "nodes", "sets", "sizes", "large")
    return slim


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that of least doc_id, of equal ids that of least hash, of equal rows any.

    Rows with a null id and no words are components of their own and all stay.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = labelled(docs, doc_id=doc_id, text=text)
    rows = scratch.table(found.groupBy("label", "doc_id", "fp").agg(F.count("*").alias("k")), "rows")
    least = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "k")).alias("r"))
    empty = rows.where(F.col("label").isNull()).select("doc_id", "fp", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.col("k")).alias("k"))
    kept = least.select("r.doc_id", "r.fp", "r.k").unionByName(empty)
    kept = scratch.table(kept.select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp"), "k"), "kept")
    single, repeated = kept.where(F.col("k") == 1), kept.where(F.col("k") > 1)
    same = lambda k: docs[doc_id].cast("long").eqNullSafe(k["k_id"]) & F.xxhash64(docs[text]).eqNullSafe(k["k_fp"])
    out = docs.join(single, same(single), "left_semi")
    if repeated.limit(1).count():
        a_row = F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("r")
        again = docs.join(repeated, same(repeated)).select(repeated["k_id"].alias("id"), repeated["k_fp"].alias("hash"), a_row)
        out = out.unionByName(again.groupBy("id", "hash").agg(F.first("r").alias("r")).select("r.*"))
    return out
