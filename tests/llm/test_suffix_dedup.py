import hashlib
import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import suffix_dedup


def brute(texts, length=400):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[p : p + length] for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[1:-1]])
        out.append((len(r), len(r) - len(kept), int(np.sum(gone[1:] & ~gone[:-1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_against_every_window(docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs).collect())
    assert got == want
    assert sum(k[2] > 0 for k in want) > 8


def brute_words(texts, length=suffix_dedup.WORDS.length):
    """For each text whether each word lies in a repeated string of words."""
    seen = Counter()
    said = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    said = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w] for w in said]
    for w in said:
        seen.update(tuple(w[p : p + length]) for p in range(len(w) - length + 1))
    return [[any(seen[tuple(w[p : p + length])] > 1 for p in range(max(0, i - length + 1), min(i, len(w) - length) + 1)) for i in range(len(w))] for w in said]


def test_words_against_every_window(docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, sum(x), sum(a and not b for a, b in zip(x, [False, *x]))) for r, x in zip(rows, brute_words([r.text for r in rows]), strict=True))
    assert Counter((r.doc_id, r.n_passage_words, r.n_passages) for r in suffix_dedup.deduplicated(docs).collect()) == want
    assert sum(k[1] > 0 for k in want) > 8


def test_hot_keys_take_the_other_way(docs, monkeypatch):
    want = Counter(tuple(r) for r in suffix_dedup.deduplicated(docs).collect())
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert Counter(tuple(r) for r in suffix_dedup.deduplicated(docs).collect()) == want


def test_texts_are_cut(docs, no_docs):
    cut = suffix_dedup.without_passages(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r, gone in zip(rows, brute_words([r.text for r in rows]), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want[r.doc_id, " ".join(w for w, x in zip(words, gone, strict=True) if not x), r.text is None] += 1
    got = Counter((r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.text is None) for r in cut.select("doc_id", "text").collect())
    assert got == want
    assert suffix_dedup.deduplicated(no_docs).count() == 0 and suffix_dedup.without_passages(no_docs).count() == 0


def test_passages_shared_by_documents(spark):
    """Planted across documents: 49 to 80 words, of which some are under and some over 400 bytes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for i, n in enumerate((49, 50, 51, 52, 60, 64, 70, 80)):
        passage = some(n)
        for j in range(3):
            planted[10 * i + j] = (n, len(passage.encode()))
            rows.append((10 * i + j, f"{some(30)} {passage} {some(20)}"))
    rows += [(1000 + i, some(200)) for i in range(20)]
    found = {r.doc_id: r for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in found.items() if r.n_passage_words} == {i for i, (n, _) in planted.items() if n >= 50}
    assert {i for i, r in found.items() if r.n_removed} == {i for i, (_, b) in planted.items() if b >= 398}  # with a space on either side


def test_multikey_order():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.choice(list(b"ab"), rng.integers(0, 40)).astype(np.uint8)) for _ in range(300)]
    group = rng.integers(0, 3, 300)
    order = suffix_dedup.multikey_order(suffix_dedup.matrix(strings, 40)[1], group)
    got = [(group[i], strings[i].ljust(40, b"\0"), len(strings[i])) for i in order]
    assert got == sorted(got)
