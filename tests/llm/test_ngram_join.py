import re
from collections import Counter

import numpy as np

from corpusloom.llm import ngram_join


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            k = len(x & sets[j])
            if k and 100 * k >= 80 * len(x | sets[j]):
                a, b = root(i), root(j)
                lead[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return Counter((d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows))


def test_against_all_pairs(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    for block in (ngram_join.BLOCK, 400):  # the second cuts candidate groups into pairs of blocks
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(docs, block=block).collect())
        assert got == want


def test_search_among_random_sets():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 300)).astype(np.uint64)
    sets = [np.unique(rng.choice(base[: rng.integers(5, 120)], rng.integers(3, 100))) for _ in range(150)]
    lead = ngram_join.linked(sets)
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    same = lambda x: [[x[i] == x[j] for j in range(len(x))] for i in range(len(x))]
    assert same(lead.tolist()) == same(want)


def test_keep_one_and_empty(docs, no_docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    assert {r.doc_id for r in kept.collect()} == want
    assert ngram_join.similar(no_docs).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), (r.component_id or 0)) for r in ngram_join.similar(df).collect()) == [(0, 0), (0, 5), (0, 5), (5, 5)]


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(4)
    made = lambda: [str(x) for x in rng.integers(0, 10**6, 60)]
    base, other, third = made(), made(), made()
    near = lambda w, i: " ".join([*w[: 10 + i], "edit", *w[11 + i :]])
    rows = [(1, " ".join(base))] * 3 + [(2, near(base, 20)), (3, near(base, 40))]  # the least row is repeated
    rows += [(4, " ".join(other)), (4, " ".join(third)), (5, near(other, 20)), (6, "")]  # one id, two texts; no words
    rows += [(6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (ngram_join.BLOCK, 60):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(docs, block=block).collect())
        assert got == brute(rows)
    kept = sorted((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted([rows[0], (4, " ".join(other)), (4, " ".join(third)), (6, "")])
    ids = [(None, t) for _, t in rows[:3]] + [(None, near(base, 20)), (None, "")]
    docs = spark.createDataFrame(ids, "doc_id long, text string").repartition(3)
    assert ngram_join.similar(docs).count() == len(ids)
    kept = [r.text for r in ngram_join.keep_one(docs).collect()]
    assert len(kept) == 2 and "" in kept


def test_groups_of_one_template():
    """Candidates that share most of their shingles: texts of one template, with values of their own or from few."""
    import random
    import time

    def brute_lead(sets):
        lead = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = sorted((lead[i], lead[j]))
                    lead = [a if x == b else x for x in lead]
        return lead

    rng = random.Random(1)
    for _ in range(60):
        bases = [rng.sample(range(60), rng.randint(3, 20)) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(1, 50)):
            own = set(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                own.add(rng.randint(0, 80) if rng.random() < 0.5 else rng.randint(100, 10**6))
            sets.append(np.array(sorted(own)[rng.randint(0, 1) :], np.uint64))
        assert ngram_join.linked(sets).tolist() == brute_lead(sets)
    assert ngram_join.linked([]).tolist() == []
    values = lambda shared, i, n: np.array([*shared, *range(1000 + n * i, 1000 + n * i + n)], np.uint64)
    began = time.perf_counter()
    apart = [values(range(10), i, 2) for i in range(100_000)]  # 10 of 12 shared: 0.71
    assert (ngram_join.linked(apart) == np.arange(100_000)).all()
    near = [values([x for x in range(12) if x != i % 12], i, 1) for i in range(100_000)]  # 11 of 12 within a dozenth, 10 across
    assert (ngram_join.linked(near) == np.arange(100_000) % 12).all()
    assert time.perf_counter() - began < 60
