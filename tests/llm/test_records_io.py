import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from compare import DATA
from corpusloom.llm import bpe, packed_bpe, queries, records_io

BYTES = public_tokenizers.path("byte_bpe_50k.json")
OWN, LIBRARY = bpe.Bpe(bpe.read_spec(BYTES)), Tokenizer.from_file(BYTES)
PACKED, SMALL = packed_bpe.PackedEncoder(OWN), packed_bpe.PackedEncoder(OWN, slots=64)
ODD = ["<|endoftext|>a<|endoftext|>", "don't 'S we'LL 're'd 'lll ''s x'", "a 't  'll", "² ٣ ①", "日本語 テスト", "a  b   c  d  \n\n d\n", " ", "  ", "\n x", "x　", "🎉‍🎉", "é" * 50, "'", "x'", "r'e"]


def encoded(encoder, texts):
    out = []
    for first, ids, bounds in encoder.encode(pa.array(texts, pa.string())):
        assert first == len(out)
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab'strelvdm .1\n\t  é!", max_size=40)), max_size=6))
def test_any_texts(texts):
    want = list(map(library, texts))
    assert encoded(PACKED, texts) == want
    assert encoded(SMALL, texts) == want


def test_odd_texts():
    rows = [*ODD, None, "", *ODD]
    assert encoded(PACKED, rows) == encoded(SMALL, rows) == list(map(library, rows))


def test_frames():
    payload = records_io.payload_of(-3, np.array([0, 65535, 7]), False)
    whole = records_io.frame(payload) + records_io.frame(records_io.payload_of(None, np.array([1 << 20]), True))
    stream = io.BytesIO(whole)
    doc, ids = records_io.parsed(records_io.read_frame(stream))
    assert (doc, ids.tolist()) == (-3, [0, 65535, 7])
    doc, ids = records_io.parsed(records_io.read_frame(stream))
    assert (doc, ids.tolist()) == (None, [1 << 20]) and records_io.read_frame(stream) is None
    for i in range(len(records_io.frame(payload))):  # any flipped byte is found
        with pytest.raises(records_io.Damaged):
            records_io.read_frame(io.BytesIO(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :]))
    with pytest.raises(records_io.Damaged):
        records_io.read_frame(io.BytesIO(whole[:20]))


def brute(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*library(text), 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, docs, no_docs, tmp_path):
    extra = spark.createDataFrame([*((None, t) for t in ODD[:3]), *((7, t) for t in ODD)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    ties = {r.text: r.h for r in rows.selectExpr("text", "xxhash64(text) as h").collect()}
    kept = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, ties[r.text]))
    want = brute(kept)
    for most in (1 << 26, 2000):
        folder = f"{tmp_path}/{most}"
        manifest = records_io.write_records(rows, BYTES, folder, file_bytes=most)
        assert manifest.agg({"n_records": "sum"}).first()[0] == len(kept)
        assert Counter(map(tuple, records_io.read_records(spark, folder, digests=True).collect())) == Counter(want)
        drawn = [tuple(r) for r in records_io.read_shuffled(spark, folder, 1, digests=True).collect()]
        assert Counter(drawn) == Counter(want) and drawn != sorted(drawn, key=lambda r: r[1])
        assert drawn != [tuple(r) for r in records_io.read_shuffled(spark, folder, 2, digests=True).collect()]
    assert sorted(r.start for r in records_io.read_records(spark, folder).collect() if r.ids[-1] == 0) == sorted(w[1] for w in want)
    records_io.write_records(no_docs, BYTES, f"{tmp_path}/none")
    assert records_io.read_records(spark, f"{tmp_path}/none").count() == records_io.read_shuffled(spark, f"{tmp_path}/none", 1).count() == 0


def test_damage_and_leftovers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(50)], "doc_id long, text string")
    records_io.write_records(rows, BYTES, str(tmp_path), file_bytes=300)
    (tmp_path / "000000-000000-lost.rec").write_bytes(b"half of a rec")  # as an attempt leaves it whose executor was lost
    assert records_io.read_records(spark, str(tmp_path)).count() == 50
    file = sorted(tmp_path.glob("*.rec"))[3]
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="damaged or cut off"):
        records_io.read_records(spark, str(tmp_path)).collect()


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.op12_token_records(spark, str(DATA)).collect())) == Counter(brute(rows))
