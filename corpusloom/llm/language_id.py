"""Language identification by interpolated Kneser-Ney character models.

A text is its words (runs of letters, lower-cased); a word is its characters
between two boundaries.  Every language has a model of order ``ORDER`` over these;
a text gets the language of lowest cross-entropy per character.

1. Character n-grams of the training texts are counted by language: summed in
   each task over its distinct words, then shuffled.  Continuation counts, totals
   of contexts and discounts are taken from all of them, in Spark, and all of them
   are in the models.
2. Models are sorted arrays of n-gram hashes, with the discounted share of each
   n-gram and the back-off weight of each context, a column per language.  Up to
   ``GRAMS`` n-grams (some 50 bytes each) are broadcast as one.  More are cut into
   blocks by the character before the last: all that the probability of a
   character is made of hangs on the character before it, but for the 1-grams,
   which every block has.  So a word's log probability is the sum of what the
   blocks give for its characters.  Blocks are put together by the executors and
   kept as a table in the shared folder; a task gathers the words of ``HELD`` bytes
   of text, then reads one block after the other.  A block holds ``GRAMS`` n-grams
   of four languages, fewer of more, or those of the characters of one bucket of
   ``BUCKETS``, if these are more.
3. One in 64 training texts isn't counted but scored; how often the best language
   is the right one there, by its lead, calibrates ``score``, and how high the
   cross-entropy of right ones gets sets the limit of ``rejected``.

Only texts and languages are learned from.  Texts that are null or have no letter
are ``und`` with score 0, and so is every text if nothing was learned; of tied
languages the first by name is taken.  Rows without a language or with a null id
aren't learned from; equal rows give equal results; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import io
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernel
from corpusloom.llm.scratch import Scratch

ORDER, GRAMS, SLICE = 4, 1 << 20, 2 << 20
CACHED, MERGE = 1_000_000, 1_000_000
#: Buckets of characters that blocks are made of; bytes of text whose words meet the blocks together; characters scored at once.
BUCKETS, HELD, AT_ONCE = 1024, 64 << 20, 1 << 18
#: Bins of a lead (characters' standard units) and of a cross-entropy (nats).
LEAD_BIN, LEADS, ENTROPY_BIN, ENTROPIES = 0.25, 200, 0.05, 400
UNKNOWN = "und"
LETTERS = kernel.ALNUM.copy()
LETTERS[0x30:0x3A] = 0
_ODD = np.random.default_rng(99).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NOTHING = np.uint64(0x5EED)


def symbols(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of the words, lower-cased, with a 0 before, between and after them."""
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - lengths  # each word after one boundary
    flat = np.zeros(int((lengths + 1).sum()) + 1, np.uint8)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(to, lengths) + inner] = raw[np.repeat(starts, lengths) + inner]
    return np.frombuffer(flat.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)


def ngrams(c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of the 0- to ORDER-grams that end at each position, order of the longest within its word)."""
    at = np.arange(len(c))
    boundary = np.maximum.accumulate(np.where(c == 0, at, 0))
    longest = np.zeros(len(c), np.int64)
    longest[1:] = np.minimum(ORDER, at[1:] - boundary[:-1] + 1)
    wide, hashes, sums = c.astype(np.uint64) + np.uint64(1), [np.full(len(c), NOTHING)], np.zeros(len(c), np.uint64)
    for o in range(ORDER):
        sums[o:] += wide[: len(c) - o] * _ODD[o]
        hashes.append(kernel.mix(sums + np.uint64(o)))
    return hashes, longest


def _unique_words(held: list[tuple]) -> tuple:
    """Distinct (language, hash) of word lists, with counts and bytes."""
    lang, h, n = (np.concatenate([x[i] for x in held]) for i in range(3))
    lengths = np.concatenate([np.diff(x[3]) for x in held])
    raw, starts = np.concatenate([x[4] for x in held]), np.concatenate([[0], np.cumsum(lengths)])
    _, first, back = np.unique(h ^ kernel.mix(lang.astype(np.uint64)), return_index=True, return_inverse=True)
    size = lengths[first]
    to = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(starts[first] - to[:-1], size) + np.arange(to[-1])
    return lang[first], h[first], np.bincount(back, n, len(first)), to, raw[take]


COUNTS = "lang string, o int, g long, ctx long, suf long, prev long, open boolean, n long"


def _grams_of(words: tuple, names: list[str]):
    lang, _, n, offsets, raw = words
    for k, name in enumerate(names):
        mine = np.flatnonzero(lang == k)
        if not len(mine):
            continue
        c = symbols(raw, offsets[mine], offsets[mine + 1])
        hashes, longest = ngrams(c)
        word = np.cumsum(c == 0) - 1
        word[c == 0] -= 1  # a closing boundary belongs to the word before it
        weight = n[mine][np.maximum(word, 0)]
        for o in range(1, ORDER + 1):
            at = np.flatnonzero(longest >= o)
            g, first, back = np.unique(hashes[o][at], return_index=True, return_inverse=True)
            where = at[first]
            opens = (longest[where] == o) & (c[where - o + 1] == 0) & (o > 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(g)),
                    pa.array(np.full(len(g), o, np.int32)),
                    pa.array(kernel.as_long(g)),
                    pa.array(kernel.as_long(hashes[o - 1][where - 1])),
                    pa.array(kernel.as_long(hashes[o - 1][where])),
                    pa.array(kernel.as_long(hashes[1][where - 1])) if o > 1 else pa.array(np.zeros(len(g), np.int64)),
                    pa.array(opens),
                    pa.array(np.bincount(back, weight[at], len(g)).astype(np.int64)),
                ],
                [x.split()[0] for x in COUNTS.split(", ")],
            )


def _counted(batches):
    names: dict[str, int] = {}
    held: list = []
    size = 0
    for batch in batches:
        codes = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
        for a, _, raw, offsets in kernel.text_slices(batch.column(0), SLICE):
            starts, ends, by_text = kernel.words(raw, offsets, LETTERS)
            if not len(starts):
                continue
            h = kernel.span_hash(kernel.running(LETTERS[raw]), starts, ends)
            lang = np.repeat(codes[a : a + len(offsets) - 1], np.diff(by_text))
            _, first, n = np.unique(h ^ kernel.mix(lang.astype(np.uint64)), return_index=True, return_counts=True)
            lengths = (ends - starts)[first]
            to = np.concatenate([[0], np.cumsum(lengths)])
            held.append((lang[first], h[first], n, to, raw[np.repeat(starts[first] - to[:-1], lengths) + np.arange(to[-1])]))
            size += len(first)
            if size > MERGE:
                held = [_unique_words(held)]
                size = len(held[0][0])
                if size > MERGE // 2:
                    yield from _grams_of(held[0], list(names))
                    held, size = [], 0
    if held:
        yield from _grams_of(_unique_words(held), list(names))


def shares(rows: pa.Table) -> pa.Table:
    """lang, g, ctx and share of counts (COUNTS) that are all there are; ``all_shares`` does the same in Spark."""
    lang = rows["lang"].combine_chunks().dictionary_encode()
    k = lang.indices.to_numpy().astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    o, n, opens = rows["o"].to_numpy(), rows["n"].to_numpy().astype(np.float64), rows["open"].to_numpy().astype(bool)
    g, ctx, suf = (rows[x].to_numpy().view(np.uint64) for x in ("g", "ctx", "suf"))
    count = len(lang.dictionary)
    grams, at = np.unique(g, return_inverse=True)
    contexts, under = np.unique(ctx, return_inverse=True)
    before, known = _found(grams, suf)
    extends = (o > 1) & known
    kinds = np.bincount(before[extends] * count + k[extends], minlength=len(grams) * count)
    used = np.where((o == ORDER) | opens, n, np.maximum(kinds[at * count + k] if count else n, 1))
    share = np.zeros(len(rows))
    for i in range(1, ORDER + 1):
        for j in range(count):
            mine = np.flatnonzero((o == i) & (k == j))
            if len(mine):
                total = np.bincount(under[mine], used[mine], len(contexts))
                share[mine] = (used[mine] - discount(np.count_nonzero(used[mine] == 1), np.count_nonzero(used[mine] == 2))) / total[under[mine]]
    return pa.table({"lang": rows["lang"], "o": rows["o"], "g": rows["g"], "ctx": rows["ctx"], "share": pa.array(share)})


def discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def merged(counts: DataFrame) -> DataFrame:
    """COUNTS of all tasks, a row for each language and n-gram."""
    first = (F.min(c).alias(c) for c in ("ctx", "suf", "prev"))
    return counts.groupBy("lang", "o", "g").agg(*first, F.max("open").alias("open"), F.sum("n").alias("n"))


def all_shares(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, list[str], np.ndarray, int]:
    """(lang, o, g, ctx, bucket and share of every n-gram, the share of an unknown character, languages, n-grams by bucket, 1-grams)."""
    counts = scratch.table(counts, "counts")
    # Lower orders count what an n-gram follows, except at a word's start, where nothing can precede it.
    kinds = counts.where(F.col("o") > 1).groupBy("lang", F.col("suf").alias("g"), (F.col("o") - 1).alias("o")).agg(F.count("*").alias("kinds"))
    plain = (F.col("o") == ORDER) | F.col("open")
    used = counts.join(kinds, ["lang", "o", "g"], "left").withColumn("used", F.when(plain, F.col("n")).otherwise(F.coalesce("kinds", F.lit(1))))
    total = F.sum("used").over(Window.partitionBy("lang", "o", "ctx"))  # as many rows as characters may follow
    bucket = F.when(F.col("o") > 1, F.pmod("prev", F.lit(BUCKETS))).cast("int")  # 1-grams belong to all
    used = scratch.table(used.select("lang", "o", "g", "ctx", bucket.alias("bucket"), "used", total.alias("total")), "used")
    cells = used.groupBy("lang", "o", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("used") == 1).alias("once"), F.count_if(F.col("used") == 2).alias("twice")).collect()  # bounded by the buckets
    sizes, singles, seen = np.zeros(BUCKETS, np.int64), 0, defaultdict(Counter)
    for r in cells:
        seen[r.lang, r.o].update(once=r.once, twice=r.twice)
        if r.bucket is None:
            singles += r.n
        else:
            sizes[r.bucket] += r.n
    cuts = [(lang, o, discount(x["once"], x["twice"])) for (lang, o), x in seen.items()]
    cuts = F.broadcast(counts.sparkSession.createDataFrame(cuts, "lang string, o int, cut double"))  # a row for each language and order
    letters = used.where(F.col("o") == 1).select("g").distinct().count()
    share = (F.col("used") - F.col("cut")) / F.col("total")
    return used.join(cuts, ["lang", "o"]).select("lang", "o", "g", "ctx", "bucket", share.alias("share")), 1.0 / (letters + 1), sorted({lang for lang, _ in seen}), sizes, singles


def packed(sizes: np.ndarray, most: int) -> np.ndarray:
    """The block of each bucket: neighbours share one as long as they hold ``most`` together."""
    blocks, held, block = np.zeros(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            block, held = block + 1, 0
        blocks[i] = block
        held += n
    return blocks


class Models:
    """Sorted n-gram and context hashes, with a column of shares and back-off weights per language.

    Made from ``all_shares`` and the share of an unknown character, or from counts.
    """

    def __init__(self, rows: pa.Table, floor: float | None = None, names: list[str] | None = None):
        if "share" not in rows.column_names:
            rows = shares(rows)
        lang = rows["lang"].combine_chunks().dictionary_encode()
        self.names = names or (sorted(lang.dictionary.to_pylist()) if len(rows) else [])
        place = np.array([self.names.index(x) for x in lang.dictionary.to_pylist()], np.int64)
        k = place[lang.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64)
        g, ctx = (rows[x].to_numpy().view(np.uint64) for x in ("g", "ctx"))
        share = rows["share"].to_numpy()
        self.grams, at = np.unique(g, return_inverse=True)
        self.contexts, under = np.unique(ctx, return_inverse=True)
        count = len(self.names)
        self.share = np.zeros((len(self.grams), count), np.float32)
        self.share[at, k] = share
        held = np.bincount(under * count + k, share, len(self.contexts) * count)
        self.weight = (1 - held).reshape(len(self.contexts), count).astype(np.float32)
        self.floor = floor or 1.0 / (np.count_nonzero(np.unique(g[rows["o"].to_numpy() == 1])) + 1)

    def word_scores(self, c: np.ndarray, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(natural log probability by word and language, characters with the closing boundary) of words as symbols.

        Where buckets are given that are ``mine``, other characters count nothing.
        """
        hashes, longest = ngrams(c)
        at = np.arange(1, len(c))
        if mine is not None:
            at = at[mine[(hashes[1][:-1] % np.uint64(BUCKETS)).astype(np.int64)]]
        p = np.full((len(at), len(self.names)), self.floor, np.float32)
        for o in range(1, ORDER + 1):
            use = np.flatnonzero(longest[at] >= o)
            context, known = _found(self.contexts, hashes[o - 1][at[use] - 1])
            gram, seen = _found(self.grams, hashes[o][at[use]])
            q = p[use]
            q[known] *= self.weight[context[known]]
            q[seen] += self.share[gram[seen]]
            p[use] = q
        firsts = np.flatnonzero(c[:-1] == 0)
        logs = np.log(p)
        if mine is not None:
            logs = np.zeros((len(c) - 1, len(self.names)), np.float32)
            logs[at - 1] = np.log(p)
        return np.add.reduceat(logs, firsts, axis=0), np.diff(np.append(firsts, len(c) - 1))


class Blocks:
    """Models too large to be broadcast, a row of a table for each block."""

    def __init__(self, rows: DataFrame, floor: float, names: list[str], blocks: np.ndarray, scratch: Scratch):
        self.names, self.floor, self.blocks, self.n = names, floor, blocks, int(blocks.max()) + 1
        every = F.explode(F.sequence(F.lit(0), F.lit(self.n - 1)))
        block = F.element_at(F.lit(blocks.tolist()), F.col("bucket") + 1).cast("int")
        dealt = rows.where("bucket IS NULL").withColumn("block", every).unionByName(rows.where("bucket IS NOT NULL").withColumn("block", block))
        # Blocks are bounded, so one may be put together in one task.
        made = dealt.groupBy("block").applyInArrow(lambda key, table: _block(key, table, floor, names), "block int, arrays binary")
        scratch.table(made, "blocks")
        self.path = f"{scratch.base}/blocks"

    def load(self, block: int) -> Models:
        store, base = fs.FileSystem.from_uri(self.path)
        found = ds.dataset(base, filesystem=store, format="parquet").to_table(columns=["arrays"], filter=ds.field("block") == block)
        models = Models.__new__(Models)
        models.names, models.floor = self.names, self.floor
        with np.load(io.BytesIO(found["arrays"][0].as_py())) as arrays:
            models.__dict__ |= {k: arrays[k] for k in ARRAYS}
        return models

    def word_scores(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What one model of all blocks would give."""
        firsts = np.flatnonzero(c[:-1] == 0)
        cuts = np.unique(np.searchsorted(firsts, np.arange(0, len(c), AT_ONCE)))
        cuts = np.append(cuts[cuts < len(firsts)], len(firsts))
        ends = np.append(firsts, len(c) - 1)
        scores = np.zeros((len(firsts), len(self.names)))
        for block in range(self.n):
            models, mine = self.load(block), self.blocks == block
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                scores[a:b] += models.word_scores(c[ends[a] : ends[b] + 1], mine)[0]
        return scores.astype(np.float32), np.diff(ends)


ARRAYS = ("grams", "contexts", "share", "weight")


def _block(key, table: pa.Table, floor: float, names: list[str]) -> pa.Table:
    models, out = Models(table, floor, names), io.BytesIO()
    np.savez(out, **{k: getattr(models, k) for k in ARRAYS})
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "arrays": pa.array([out.getvalue()], pa.binary())})


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class Scorer:
    """Scores of words by hash, kept between slices and emptied when full."""

    def __init__(self, models: Models):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.h, self.scores, self.n = np.zeros(0, np.uint64), np.zeros((0, len(self.models.names)), np.float32), np.zeros(0, np.int64)

    def know(self, words: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Scores those of the words, sorted by hash, that aren't kept yet."""
        new = ~_found(self.h, words)[1]
        if new.any() and len(self.h) + np.count_nonzero(new) > CACHED:
            self.clear()
            new[:] = True
        if new.any():
            scores, n = self.models.word_scores(symbols(raw, starts[new], ends[new]))
            every = np.concatenate([self.h, words[new]])
            order = np.argsort(every, kind="stable")
            self.h, self.scores, self.n = every[order], np.concatenate([self.scores, scores])[order], np.concatenate([self.n, n])[order]

    def ahead(self, texts: pa.Array) -> None:
        """Scores all words of many texts together, so that each block is read once."""
        held: list[tuple] = []
        for _, _, raw, offsets in kernel.text_slices(texts, SLICE):
            starts, ends, _ = kernel.words(raw, offsets, LETTERS)
            if len(starts):
                h, first = np.unique(kernel.span_hash(kernel.running(LETTERS[raw]), starts, ends), return_index=True)
                lengths = (ends - starts)[first]
                to = np.concatenate([[0], np.cumsum(lengths)])
                held.append((np.zeros(len(h), np.int64), h, np.ones(len(h), np.int64), to, raw[np.repeat(starts[first] - to[:-1], lengths) + np.arange(to[-1])]))
        if held:
            _, h, _, offsets, raw = _unique_words(held)
            order = np.argsort(h)
            self.know(h[order], raw, offsets[:-1][order], offsets[1:][order])

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability by text and language, characters by text)."""
        starts, ends, by_text = kernel.words(raw, offsets, LETTERS)
        texts = len(offsets) - 1
        total, chars = np.zeros((texts, len(self.models.names))), np.zeros(texts, np.int64)
        if not len(starts):
            return total, chars
        h = kernel.span_hash(kernel.running(LETTERS[raw]), starts, ends)
        words, first, back = np.unique(h, return_index=True, return_inverse=True)
        self.know(words, raw, starts[first], ends[first])
        at = np.searchsorted(self.h, words)[back]
        some = np.flatnonzero(np.diff(by_text))
        total[some] = np.add.reduceat(self.scores[at], by_text[some], axis=0)
        chars[some] = np.add.reduceat(self.n[at], by_text[some])
        return total, chars


def _gathered(batches, scorer: Scorer):
    """The batches, after the words of about ``HELD`` bytes of them have been scored."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > HELD:
            scorer.ahead(pa.chunked_array([x.column(1) for x in held]))
            yield from held
            held, size = [], 0
    if held:
        scorer.ahead(pa.chunked_array([x.column(1) for x in held]))
        yield from held


def _guessed(batches, models: Models):
    scorer, names = Scorer(models), models.names
    if isinstance(models, Blocks):
        batches = _gathered(batches, scorer)
    for batch in batches:
        lettered = batch.column(2).to_pylist()
        for a, b, raw, offsets in kernel.text_slices(batch.column(1), SLICE):
            total, chars = scorer.texts(raw, offsets)
            entropy = -total / np.maximum(chars, 1)[:, None]
            order = np.argsort(entropy, axis=1, kind="stable") if names else np.zeros((b - a, 0), np.int64)
            rows = np.arange(b - a)
            usable = np.array(lettered[a:b], bool) & bool(names)
            best = order[:, 0] if names else rows
            lowest = entropy[rows, best] if names else np.zeros(b - a)
            lead = (entropy[rows, order[:, 1]] - lowest) * np.sqrt(chars) if len(names) > 1 else np.full(b - a, LEAD_BIN * LEADS)
            guess = [names[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), usable.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(guess), pa.array(np.where(usable, lead, 0.0)), pa.array(np.where(usable, lowest, 0.0)), batch.column(3).slice(a, b - a)],
                ["doc_id", "lang_pred", "lead", "entropy", "also"],
            )


def guesses(docs: DataFrame, models, *, text: str = "text", doc_id: str = "doc_id", also) -> DataFrame:
    """doc_id, lang_pred, lead and entropy of every row; ``also`` is a string column that is passed on."""
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), lettered.alias("lettered"), also.alias("also"))
    return source.mapInArrow(lambda batches: _guessed(batches, models.value), "doc_id long, lang_pred string, lead double, entropy double, also string")


def slope(leads: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> float:
    """Of the logistic curve through a half at no lead that fits best; two made-up texts keep it finite."""
    leads = np.concatenate([leads, [1.0, 1.0]])
    right, wrong = np.concatenate([right, [1.0, 0.0]]), np.concatenate([wrong, [0.0, 0.1]])
    a = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * leads, -50, 50)))
        gradient = float(((right * (1 - p) - wrong * p) * leads).sum())
        bend = float(((right + wrong) * p * (1 - p) * leads**2).sum()) + 1e-9
        a = float(np.clip(a + gradient / bend, 0.01, 20))
    return a


def learned(counts: DataFrame, scratch: Scratch) -> Models | Blocks:
    """The models of all n-grams, in one or, beyond ``GRAMS``, in blocks; they score alike."""
    rows, floor, names, sizes, singles = all_shares(counts, scratch)
    most = GRAMS * 4 // max(4, len(names))  # a model has a column for every language
    if singles + int(sizes.sum()) <= most:
        return Models(rows.drop("bucket").toArrow(), floor)
    return Blocks(rows, floor, names, packed(sizes, most), scratch)


def identified(docs: DataFrame, training: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, cross_entropy, rejected; learned from training."""
    spark = docs.sparkSession
    usable = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    aside = F.crc32(F.col("doc_id").cast("string")) % 64 == 1
    counts = merged(usable.where(~F.coalesce(aside, F.lit(True))).select("text", "lang").mapInArrow(_counted, COUNTS))
    scratch = Scratch(spark, "language")
    models = learned(counts, scratch)
    scratch.drop("counts", "used")
    held = spark.sparkContext.broadcast(models)
    tried = guesses(usable.where(aside), held, also=F.col("lang")).where(F.col("lang_pred") != UNKNOWN)
    bins = tried.groupBy(
        "lang_pred",
        (F.col("lang_pred") == F.col("also")).alias("right"),
        F.least(F.floor(F.col("lead") / LEAD_BIN), F.lit(LEADS)).alias("lead"),
        F.least(F.floor(F.col("entropy") / ENTROPY_BIN), F.lit(ENTROPIES)).alias("entropy"),
    ).agg(F.count("*").alias("n"))
    found = bins.collect()  # bounded by the bins
    leads = np.array([r.lead * LEAD_BIN for r in found])
    n, right = np.array([r.n for r in found], float), np.array([r.right for r in found], bool)
    steep = slope(leads, n * right, n * ~right)
    limits = []
    for name in models.names:
        mine = sorted((r.entropy, r.n) for r in found if r.lang_pred == name and r.right)
        most, total = ENTROPIES * ENTROPY_BIN, sum(x for _, x in mine)
        if total >= 20:
            upto = np.cumsum([x for _, x in mine])
            most = (mine[int(np.searchsorted(upto, 0.995 * total))][0] + 1) * ENTROPY_BIN * 1.1
        limits.append(most)
    out = guesses(docs, held, text=text, doc_id=doc_id, also=F.lit(None).cast("string"))
    score = F.when(F.col("lang_pred") == UNKNOWN, F.lit(0.0)).otherwise(1 / (1 + F.exp(-steep * F.col("lead"))))
    limit = F.lit(float("inf"))
    for name, most in zip(models.names, limits, strict=True):
        limit = F.when(F.col("lang_pred") == name, F.lit(float(most))).otherwise(limit)
    out = out.withColumn("score", score)
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < 0.6) | (F.col("entropy") > limit)
    return out.select("doc_id", "lang_pred", "score", F.col("entropy").alias("cross_entropy"), rejected.alias("rejected"))
