import hashlib
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
OWN, LIBRARY = bpe.Bpe(bpe.read_spec(BYTES)), Tokenizer.from_file(BYTES)
OWN_WORDS, LIBRARY_WORDS = bpe.WordEnds(bpe.read_spec(WORDS)), Tokenizer.from_file(WORDS)
SPECIAL = ["<|endoftext|>a<|endoftext|>", "<|startoftext|> b <|endoftext|", "don't 'S we'LL", "² ٣ ①", "日本語 テスト", "a b c  \n\n d", "🎉‍🎉", "é" * 50]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert len(OWN_WORDS.encode(text)) == len(LIBRARY_WORDS.encode(text, add_special_tokens=False).ids)


def test_scan_and_heap_agree():
    for word in ("internationalization", " the", "aaaaaaaaaaaaaaaaaaaaaaaaa", "ééé", "x" * 100):
        s = "".join(OWN.letters[b] for b in word.encode())
        assert OWN.encode_words([word])[0] == OWN.heap(s, [*range(len(s) + 1)])


def test_documents(spark, docs, no_docs, texts):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(SPECIAL)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    want, counts = Counter(), Counter()
    for d, t in [tuple(r) for r in rows.collect()]:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))] += 1
        n = len(LIBRARY_WORDS.encode(t or "", add_special_tokens=False).ids)
        counts[d, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, bpe.encode_decode(rows, BYTES, digests=True).collect())) == want
    full = bpe.encode_decode(rows, BYTES).collect()
    assert Counter((r.doc_id, r.n_tokens, sha(",".join(map(str, r.ids))), sha(r.decoded)) for r in full) == want
    assert Counter(map(tuple, token_counts.token_counts(rows, WORDS).collect())) == counts
    assert Counter(map(tuple, token_counts.token_counts(rows, WORDS, frequent=3, sample_rows=2).collect())) == counts
    assert bpe.encode_decode(no_docs, BYTES).count() == token_counts.token_counts(no_docs, WORDS).count() == 0
