import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical_search
from corpusloom.llm.scratch import Scratch


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, items, k):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in docs:
            m = 50 + (50 * c.total() * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, d, -score] += 1
    return out


@pytest.fixture(scope="module")
def items(texts):
    rng = random.Random(2)
    out = [(0, None), (1, ""), (2, "nothing like this anywhere"), (None, "the cat"), (3, "the cat sat on the mat"), (3, "the cat sat on the mat"), (4, "ΣΣ é " + "é" * 700)]
    return out + [(10 + i, " ".join(rng.choice(texts[13:] or [""]).split()[: rng.randint(1, 50)])) for i in range(20)] + [(99, " ".join(t or "" for t in texts))]


@pytest.mark.parametrize("shard_docs, shard_words, block_terms, k", [(4096, 1 << 21, 1 << 20, 50), (7, 1 << 21, 200, 5), (1, 10, 1 << 20, 3), (64, 300, 1 << 20, 1)])
def test_against_all_documents(spark, docs, texts, items, shard_docs, shard_words, block_terms, k):
    extra = spark.createDataFrame([(None, "the cat"), (None, None), (-5, "The CAT, the_mat;"), *((500 + i, "the cat sat") for i in range(90))], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra).repartition(3)
    index = lexical_search.build_index(rows, Scratch(spark, "test11"), shard_docs=shard_docs, shard_words=shard_words)
    asked = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, term string, rank int").repartition(2)
    found = lexical_search.search(index, asked, k=k, block_terms=block_terms)
    assert Counter(map(tuple, found.collect())) == brute([tuple(r) for r in rows.collect()], items, k)


def test_empty_tables(spark, docs, no_docs):
    some = spark.createDataFrame([("x", "the cat")], "item_id string, text string")
    none = lexical_search.build_index(no_docs, Scratch(spark, "test11"))
    assert lexical_search.search(none, some).count() == 0
    index = lexical_search.build_index(docs, Scratch(spark, "test11"))
    assert lexical_search.search(index, some.limit(0)).count() == 0
    assert {r.item_id for r in lexical_search.search(index, some).collect()} == {"x"}


def test_ranks_and_spans():
    rng = np.random.default_rng(1)
    doc = rng.integers(0, 100, 1000)
    row = {"n_postings": 1000, "n_docs": 100, "ids": np.arange(100).tobytes(), "null_ids": bytes(13), "terms": b"", "offsets": b"", "impacts": np.arange(1000, dtype=np.int32).tobytes(), "bits": lexical_search._levels(doc, 100).tobytes()}
    shard = lexical_search._Shard(row)
    order = np.arange(1000)
    for level in range(shard.depth):
        bit = (doc[order] >> (shard.depth - 1 - level)) & 1
        at = np.arange(1001)
        assert (shard.rank(np.full(1001, level), at) == np.concatenate([[0], np.cumsum(bit)])).all()
        assert (shard.impacts[level] == order).all()
        order = np.concatenate([order[bit == 0], order[bit == 1]])


def test_most_documents_are_never_opened(spark, monkeypatch):
    rng = random.Random(4)
    rare = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(["a", "b", "c"], k=20)) + (" " + " ".join(rare[i % 40 * 10 : i % 40 * 10 + 10]) if i < 400 else "")) for i in range(4000)]
    index = lexical_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Scratch(spark, "test11"))
    shard = lexical_search._Shard(index.shards.first().asDict())
    opened = []
    plain = lexical_search._Frontier.opened
    monkeypatch.setattr(lexical_search._Frontier, "opened", lambda self, shard: opened.append(len(self.item)) or plain(self, shard))
    import pyarrow as pa

    from corpusloom.llm import kernel

    _, _, raw, offsets = next(kernel.text_slices(pa.array(["a b c " + " ".join(rare[:10])])))
    held = np.unique(kernel.word_hashes(raw, offsets, kernel.ALNUM)[0])
    lo, hi = shard.spans(held)
    weight = np.where(hi - lo > 1000, 1, 5000)
    best = lexical_search._Best(1, 10)
    zero = np.zeros(1, np.int64)
    bound = np.array([(weight * shard.impacts[0][lo]).sum()])
    lexical_search._search(shard, lexical_search._Frontier(zero, zero, zero, bound, np.array([len(held)]), lo, hi, weight), best)
    assert set(best.id) <= set(range(0, 400, 40)) and len(best.id) == 10
    assert sum(opened) < 1000
