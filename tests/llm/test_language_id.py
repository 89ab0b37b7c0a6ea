import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language_id
from corpusloom.llm.queries import op9_language_id
from corpusloom.llm.scratch import Scratch


def made(n=300):
    rng = np.random.default_rng(8)
    parts = {"xx": ["ka", "no", "ri", "to"], "yy": ["sch", "ung", "er", "ein"], "zz": ["ión", "ñar", "des", "lo"]}
    return [(i, " ".join("".join(rng.choice(p, 3)) for _ in range(12)), lang) for i, (lang, p) in enumerate(list(parts.items()) * (n // 3))]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string")
    test = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    found = language_id.identified(docs, docs.where(~F.col("doc_id").isin(test))).join(docs, "doc_id").where(F.col("doc_id").isin(test)).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_hard_texts(docs, no_docs):
    found = {r.doc_id: r for r in language_id.identified(docs, docs).collect()}
    assert len(found) == docs.select("doc_id").distinct().count()
    assert {d for d, r in found.items() if r.lang_pred == "und"} == {0, 1, 2, 8}
    assert all(r.score == 0 for r in found.values() if r.lang_pred == "und")
    assert language_id.identified(no_docs, no_docs).count() == 0
    assert {r.lang_pred for r in language_id.identified(docs, no_docs).collect()} == {"und"}


def test_shares_of_a_context_sum_to_one():
    import pyarrow as pa

    words = [("aa", 3), ("ab", 2), ("ba", 1), ("abc", 2)]
    raw = np.frombuffer(b"".join(w.encode() for w, _ in words), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w, _ in words])])
    held = (np.zeros(4, np.int64), np.arange(4).astype(np.uint64), np.array([n for _, n in words]), offsets, raw)
    models = language_id.Models(pa.Table.from_batches(list(language_id._grams_of(held, ["xx"]))))
    total = 0.0
    for c in "abcd":  # what may follow "a" at a word's start, and the word's end
        end, _ = models.word_scores(np.array([0, ord("a"), ord(c)], np.uint32))
        total += float(np.exp(end[0, 0]))
    alone, _ = models.word_scores(np.array([0, ord("a"), 0], np.uint32))
    first, _ = models.word_scores(np.array([0, ord("a")], np.uint32))
    total += float(np.exp(alone[0, 0]))
    assert total == pytest.approx(float(np.exp(first[0, 0])), rel=0.02)


def test_query_learns_from_training_rows_only(spark):
    from compare import DATA

    found = op9_language_id(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    accuracy = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()[0][0]
    assert accuracy > 0.95


def counted(spark, texts):
    return language_id.merged(spark.createDataFrame(texts, "text string, lang string").mapInArrow(language_id._counted, language_id.COUNTS))


def test_a_rare_language_keeps_its_part(spark, monkeypatch):
    monkeypatch.setattr(language_id, "GRAMS", 300)
    rng = np.random.default_rng(5)
    large = [(2 * i, " ".join("".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(40)), "large") for i in range(400)]
    rare = [(2 * i + 1, " ".join("".join(rng.choice(["mo", "nu", "pe", "qui"], 3)) for _ in range(3)), "rare") for i in range(12)]
    docs = spark.createDataFrame(large + rare, "doc_id long, text string, lang string")
    found = language_id.identified(docs, docs).join(docs, "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in found)


def test_shares_are_those_of_all_counts(spark):
    counts = counted(spark, [(t, lang) for _, t, lang in made(90)])
    want = {(r["lang"], r["o"], r["g"]): r["share"] for r in language_id.shares(counts.toArrow()).to_pylist()}
    rows, floor, names, sizes, singles = language_id.all_shares(counts, Scratch(spark, "test"))
    table = rows.toArrow()
    assert {(r["lang"], r["o"], r["g"]): r["share"] for r in table.to_pylist()} == pytest.approx(want)
    assert sizes.sum() + singles == len(want) and names == ["xx", "yy", "zz"]
    models = language_id.Models(table, floor)
    letters = sorted({c for _, t, _ in made(90) for c in t if c != " "})
    for start in ("", "k", "ka", "er", "des"):  # what may follow, and the word's end, is all of the mass
        symbols = lambda w: np.array([0, *map(ord, w), 0], np.uint32)
        unfinished = lambda w: models.word_scores(symbols(w)[:-1])[0][0] if w else np.zeros(3)
        after = [np.exp(unfinished(start + c) - unfinished(start)) for c in letters]
        if start:
            after.append(np.exp(models.word_scores(symbols(start))[0][0] - unfinished(start)))
        assert np.sum(after, axis=0) == pytest.approx(1, abs=0.08)


def test_blocks_score_as_one_model_does(spark, monkeypatch):
    counts = counted(spark, [(t, lang) for _, t, lang in made(150)] + [("愛と平和 и мир", "mixed")])
    whole = language_id.learned(counts, Scratch(spark, "test"))
    assert isinstance(whole, language_id.Models)
    monkeypatch.setattr(language_id, "AT_ONCE", 7)
    words = ["kanori", "ión", "schung", "xyz", "愛と", "мир", "k", "ei", *{w for _, t, _ in made(60) for w in t.split()}]
    c = np.array([0, *(x for w in words for x in [*map(ord, w), 0])], np.uint32)
    for most in (100, 300, 1):  # the last: a block for each character
        monkeypatch.setattr(language_id, "GRAMS", most)
        blocks = language_id.learned(counts, Scratch(spark, "test"))
        assert isinstance(blocks, language_id.Blocks) and blocks.n > 1 and blocks.names == whole.names
        got, n = blocks.word_scores(c)
        want, m = whole.word_scores(c)
        assert n.tolist() == m.tolist() == [len(w) + 1 for w in words]
        assert got == pytest.approx(want, rel=1e-5)


def test_many_ngrams_give_the_same_rows(spark, docs, monkeypatch):
    """Hard texts too; words met in one go, kept scores thrown away."""
    training = spark.createDataFrame(made(), "doc_id long, text string, lang string")
    texts = docs.select("doc_id", "text").unionByName(training.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = lambda: sorted(language_id.identified(texts, training).collect(), key=str)
    want = rows()
    monkeypatch.setattr(language_id, "GRAMS", 200)
    for cached, held in ((1_000_000, 1 << 20), (5, 1 << 20), (1_000_000, 1)):
        monkeypatch.setattr(language_id, "CACHED", cached)
        monkeypatch.setattr(language_id, "HELD", held)
        got = rows()
        assert [(r.doc_id, r.lang_pred) for r in got] == [(r.doc_id, r.lang_pred) for r in want]
        assert [r.cross_entropy for r in got] == pytest.approx([r.cross_entropy for r in want], rel=1e-4)


def test_buckets_share_blocks():
    assert language_id.packed(np.array([3, 3, 9, 0, 1, 2]), 6).tolist() == [0, 0, 1, 2, 2, 2]
    assert language_id.packed(np.zeros(3, np.int64), 6).tolist() == [0, 0, 0]


def test_against_kneser_ney_by_hand(spark):
    """Every probability of the interpolated models, from counts kept in dictionaries."""
    texts = [("ana bana nab", "xx"), ("banana ab ana", "xx"), ("onno non", "yy"), ("nono onon on", "yy"), ("nab nab", "xx")]
    models = language_id.Models(counted(spark, texts).toArrow())
    for k, name in enumerate(models.names):
        words = [w for t, lang in texts if lang == name for w in t.split()]
        padded = [f"^{w}$" for w in words]
        counts = [Counter() for _ in range(language_id.ORDER + 1)]
        for w in padded:
            for end in range(1, len(w)):
                for o in range(1, language_id.ORDER + 1):
                    if end - o + 1 >= 0:
                        counts[o][w[end - o + 1 : end + 1]] += 1
        used = [Counter() for _ in counts]
        for o in range(1, language_id.ORDER + 1):
            for g, n in counts[o].items():
                before = len({x for x in counts[o + 1] if x[1:] == g}) if o < language_id.ORDER else 0
                opens = g[0] == "^" and o > 1
                used[o][g] = n if o == language_id.ORDER or opens else max(before, 1)
        cut = [0.0] * len(counts)
        for o in range(1, len(counts)):
            once, twice = (sum(n == x for n in used[o].values()) for x in (1, 2))
            cut[o] = once / (once + 2 * twice) if once and twice else 0.5

        def p(g, used=used, cut=cut):
            """Of the last character of g after the others."""
            if not g:
                return models.floor
            o, context = len(g), g[:-1]
            after = {x: n for x, n in used[o].items() if x[:-1] == context}
            if not after:
                return p(g[1:])
            total = sum(after.values())
            own = max(0.0, after.get(g, 0) - cut[o]) / total if g in after else 0.0
            return own + cut[o] * len(after) / total * p(g[1:])

        for w in ("ana", "nab", "non", "b", "zzz", "banana", "onba"):
            full = f"^{w}$"
            want = sum(np.log(p(full[max(0, end - language_id.ORDER + 1) : end + 1])) for end in range(1, len(full)))
            got, n = models.word_scores(np.array([0, *map(ord, w), 0], np.uint32))
            assert n.tolist() == [len(w) + 1]
            assert got[0, k] == pytest.approx(want, rel=1e-4), (name, w)


def test_a_rare_language_is_predicted(spark, monkeypatch):
    """One row in a hundred, of a corpus with more n-grams than a block may hold."""
    monkeypatch.setattr(language_id, "GRAMS", 3000)
    rng = np.random.default_rng(11)
    syllables = {"aa": [a + b + c for a in "bcdfg" for b in "aei" for c in "lmnrs"], "bb": [a + b + c for a in "hjklp" for b in "ouy" for c in "tvwxz"], "rare": ["qui", "sto", "ma", "ne"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k], 3)) for _ in range(30)), k) for i in range(1200) for k in ["rare" if i % 100 == 0 else "aa" if i % 2 else "bb"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.identified(docs, docs).collect()}
    assert all(found[i] == k for i, _, k in rows if k == "rare")
    assert np.mean([found[i] == k for i, _, k in rows]) > 0.99
