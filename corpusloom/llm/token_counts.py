"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

Tier one is a compact table of the token counts of frequent pre-tokens, built
from the first ``sample_rows`` rows (a bounded sample that affects speed only)
and broadcast; it holds at most ``frequent`` entries, so its size is bounded.
Tier two encodes each miss once per worker and keeps it in a bounded cache.

Null and empty texts have no bytes and no tokens; repeated rows repeat; an id
may be null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import Known, WordEnds, _texts, read_spec, ship, worker

FREQUENT, SAMPLE_ROWS, LIMIT = 1 << 16, 2000, 2048


class Lengths(dict):
    """Tier one, then tier two."""

    def __init__(self, words: list[str], lengths: bytes, bpe: WordEnds):
        super().__init__(zip(words, lengths, strict=True))
        self.rare = Known(bpe, len, besides=self)

    def __missing__(self, word: str) -> int:
        return self.rare[word]


def _sampled(batches, name: str):
    find = worker(name, WordEnds).find
    counts: Counter = Counter()
    for _, texts in _texts(batches):
        for text in texts:
            counts.update(find(text))
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def _counted(batches, name: str, tier):
    bpe = worker(name, WordEnds)
    table = Lengths(*tier.value, bpe)
    for key, texts in _texts(batches):
        split = [bpe.split_text(t) for t in texts]
        table.rare.learn(split)
        n = [sum(map(table.__getitem__, words)) for words in split]
        yield pa.RecordBatch.from_arrays([key, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    frequent: int = FREQUENT,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    name = ship(spark, tokenizer)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common = (
        source.limit(sample_rows)
        .mapInArrow(lambda batches: _sampled(batches, name), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(frequent)
        .collect()
    )
    lengths = map(len, WordEnds(read_spec(tokenizer)).encode_words([r.word for r in common]))
    kept = [(r.word, n) for r, n in zip(common, lengths, strict=True) if n < 256]
    tier = spark.sparkContext.broadcast(([w for w, _ in kept], bytes(n for _, n in kept)))
    counted = source.mapInArrow(lambda batches: _counted(batches, name, tier), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
