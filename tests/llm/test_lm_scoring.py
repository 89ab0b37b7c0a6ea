import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from corpusloom.llm import gru, lm_scoring

END = object()


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def test_counts_and_base_score(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TOP", 50)  # most words go the way of the join
    rows = docs.select("doc_id", "text").collect()
    learned = [zlib.crc32(str(r.doc_id).encode()) % 10 != 0 for r in rows]
    counts = Counter(w for r, ok in zip(rows, learned, strict=True) if ok for w in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((r.doc_id, not ok, len(w := tokens(r.text)), sum(x in counts for x in w), round(sum(log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 6)) for r, ok in zip(rows, learned, strict=True))
    found = lm_scoring.scored(docs).collect()
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert {r.train_tokens for r in found} == {total}
    assert all(r.score < 0 for r in found)


def test_empty_and_nothing_to_learn(spark, no_docs):
    assert lm_scoring.scored(no_docs).count() == 0
    only = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = lm_scoring.scored(only).orderBy("n_tokens").collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]


def test_probabilities_sum_to_one():
    model = gru.Gru(2, 3).start(np.arange(64, 0, -1.0), np.array([5.0, 1.0, 2.0]))
    hidden = np.random.default_rng(0).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(model.words + 3)
    logp, _ = model.losses(np.repeat(hidden, len(every), axis=0), every)
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    model = gru.Gru(2, 3).start(np.ones(64), np.ones(3))
    ids, width = rng.integers(0, 67, 64).astype(np.int32), 4
    fresh = rng.random(64) < 0.1
    g, _ = model.gradient(ids, fresh, np.roll(ids, 3), width, np.zeros((width, gru.HIDDEN), np.float32))

    def loss():
        h, _ = model.steps(ids, fresh, np.arange(0, 65, width), np.zeros((width, gru.HIDDEN), np.float32))
        return -model.losses(h, np.roll(ids, 3))[0].astype(float).mean()

    for i in np.argsort(-np.abs(g))[:200:20]:
        keep = model.flat[i]
        model.flat[i] = keep + 1e-2
        up = loss()
        model.flat[i] = keep - 1e-2
        down = loss()
        model.flat[i] = keep
        assert g[i] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=1e-5)


def test_packed_scores_equal_single_ones():
    rng = np.random.default_rng(5)
    model = gru.Gru(2, 3).start(np.ones(64), np.ones(3))
    lengths = rng.integers(1, 40, 30)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, 67, offsets[-1]).astype(np.int32)
    whole = gru.text_scores(model, ids, offsets, 0, width=4, rows=16)
    one = [gru.text_scores(model, ids[a:b], np.array([0, b - a]), 0)[0] for a, b in zip(offsets, offsets[1:])]
    assert np.allclose(whole, one, rtol=1e-4)


def test_learns_what_follows_what(spark):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(400):  # two kinds of text with words of their own
        kind = "ab"[i % 2]
        texts.append((i, " ".join(f"{kind}{x}" for x in rng.integers(0, 30, 80))))
    found = lm_scoring.scored(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").groupBy().sum("score", "base_score").collect()[0]
    assert found[0] > found[1] + 100


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "UNIT", 4000)  # several replicas
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 30, 80))) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in lm_scoring.scored(df.repartition(n, "doc_id")).collect()} for n in (1, 23))
    assert np.allclose([one[i] for i in range(600)], [many[i] for i in range(600)], rtol=1e-3)


def test_every_token_is_learned_from():
    """The lanes hold all tokens once, whatever the remainder."""
    held = []
    model = gru.Gru(2, 3).start(np.ones(64), np.ones(3))
    trainer = gru.Trainer(model, 0.01, width=7, length=4)
    step = trainer._step
    trainer._step = lambda before, first, ids, at, state: (held.extend(at.ravel().tolist()), step(before, first, ids, at, state))[1]
    trainer.learn(np.arange(7 * 64 * 4 + 5) % 67, np.zeros(7 * 64 * 4 + 5, bool), 0)
    assert sorted(held) == list(range(7 * 64 * 4 + 5))
