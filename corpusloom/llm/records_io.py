"""Token ids as length-delimited binary records, and their shuffled reading.

Documents are range-partitioned by id and sorted inside partitions, so the files in
their order are in ascending order of ids (null first; equal ids by the text's hash,
then the text).  Every task streams its documents through the encoder into files of
about ``FILE_BYTES`` and returns what it wrote.  A record is

    length of the payload      uint64, little-endian
    masked CRC-32 of the above uint32
    payload                    int64 id, uint8 flags (1: null id, 2: ids of 4 bytes), ids of 2 or 4 bytes
    masked CRC-32 of payload   uint32

and a mask turns the checksum by 15 bits and adds a constant, so that checksums of
data that hold checksums stay sound.  Ids take two bytes where the vocabulary
allows it.  Beside each file lies its index: for every record its byte offset and
the ids before it in the file (two int64), then the file's bytes and ids, then a
masked checksum.

Each attempt of a task writes files of new names.  The manifest, a Parquet table
written last, names the files of the attempts that succeeded, so a lost executor or
a second attempt leaves at most files that nothing names.

Null and empty texts are records of the end id alone; repeated rows are records of
their own; extra columns are ignored; an empty table gives a manifest without
files.  Rows equal in id and text stay together in one task, which streams them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import ship, worker
from corpusloom.llm.packed_bpe import PackedEncoder

FILE_BYTES = 64 << 20
#: How checksums are masked.
TURN, ADDED = 15, 0xA282EAD8
HEAD, NULL_ID, WIDE = struct.Struct("<QI"), 1, 2
FRONT = struct.Struct("<qB")
FRAME = HEAD.size + 4

MANIFEST = "part int, seq int, file string, n_records long, n_tokens long, n_bytes long"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
IDS = "doc_id long, start long, ids array<int>"


class Damaged(ValueError):
    """A record or index whose checksum or length doesn't fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> TURN | crc << (32 - TURN)) + ADDED) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (NULL_ID if doc_id is None else 0) | (WIDE if wide else 0)
    return FRONT.pack(doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(document id, its token ids as little-endian uint32)."""
    doc_id, flags = FRONT.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=FRONT.size).astype("<u4")
    return None if flags & NULL_ID else doc_id, ids


def read_frame(stream) -> bytes | None:
    """The next payload of a stream, None at its end."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise Damaged("a record's length is cut off")
    length, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise Damaged("a record's length is damaged")
    payload, tail = stream.read(length), stream.read(4)
    if len(payload) < length or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise Damaged("a record is damaged or cut off")
    return payload


class _File:
    """One file being written, and its index."""

    def __init__(self, folder: str, part: int, seq: int):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.part, self.seq, self.name = part, seq, f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}"
        self.path = f"{base}/{self.name}"
        self.out = self.store.open_output_stream(f"{self.path}.rec", buffer_size=1 << 20)
        self.entries: list[tuple[int, int]] = []
        self.bytes = self.tokens = 0

    def add(self, payload: bytes, n: int) -> None:
        self.entries.append((self.bytes, self.tokens))
        self.out.write(frame(payload))
        self.bytes += len(payload) + FRAME
        self.tokens += n

    def close(self) -> tuple:
        self.out.close()
        index = np.array([*self.entries, (self.bytes, self.tokens)], "<i8").tobytes()
        with self.store.open_output_stream(f"{self.path}.idx") as out:
            out.write(index + struct.pack("<I", masked(index)))
        return self.part, self.seq, self.name, len(self.entries), self.tokens, self.bytes


def read_index(folder: str, file: str) -> np.ndarray:
    """A row of (byte offset, ids before it) per record, then the end."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/{file}.idx") as f:
        data = f.read()
    if len(data) < 20 or masked(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise Damaged(f"the index of {file} is damaged")
    return np.frombuffer(data[:-4], "<i8").reshape(-1, 2)


def _written(batches, folder: str, name: str, end: int | None, most: int):
    bpe = worker(name)
    encoder, wide = PackedEncoder(bpe), len(bpe.bytes) > 1 << 16
    tail = np.array([] if end is None else [end], np.uint32)
    part, done, file = TaskContext.get().partitionId(), [], None
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for first, ids, bounds in encoder.encode(batch.column(1)):
            for i in range(len(bounds) - 1):
                if file and file.bytes >= most:
                    done.append(file.close())
                    file = None
                file = file or _File(folder, part, len(done))
                own = np.concatenate([ids[bounds[i] : bounds[i + 1]], tail])
                file.add(payload_of(keys[first + i], own, wide), len(own))
    if file:
        done.append(file.close())
    if done:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["part", "seq", "file", "n_records", "n_tokens", "n_bytes"])


def write_records(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end: int | None = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encodes documents into record files below ``folder``, a URI that all executors reach; returns the manifest.

    end: the id appended to every document, None for none.
    """
    spark = docs.sparkSession
    name = ship(spark, tokenizer)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    done = dealt.mapInArrow(lambda batches: _written(batches, folder, name, end, file_bytes), MANIFEST)
    done.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``first``: the ids of all files before each.

    Ids are added up by partition first, and partitions are as many as a shuffle has, so the window
    without a key sees no more rows than that.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.join(parts, "part").withColumn("first", F.col("base") + F.coalesce(inside, F.lit(0))).drop("base")


def _batch(rows: list[tuple], digests: bool) -> pa.RecordBatch:
    keys, starts, ids = zip(*rows, strict=True)
    fixed = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64())]
    if digests:
        rest = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
        return pa.RecordBatch.from_arrays(fixed + rest, ["doc_id", "start", "n_tokens", "ids_crc32"])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = pa.array(np.concatenate(ids).astype(np.int32))
    return pa.RecordBatch.from_arrays([*fixed, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "start", "ids"])


def _batched(rows: Iterator[tuple], digests: bool):
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[2])
        if len(held) >= 4096 or n >= 1 << 22:
            yield _batch(held, digests)
            held, n = [], 0
    if held:
        yield _batch(held, digests)


def _in_order(batches, folder: str):
    store, base = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_stream(f"{base}/{file}.rec", buffer_size=1 << 20) as stream:
                while (payload := read_frame(stream)) is not None:
                    doc_id, ids = parsed(payload)
                    yield doc_id, first, ids
                    first += len(ids)


def read_records(spark: SparkSession, folder: str, *, digests: bool = False) -> DataFrame:
    """Every record, checked: doc_id, start (ids of all documents before it), ids; or digests in place of the ids."""
    named = files(spark, folder).select("file", "first")
    count = max(1, min(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count(), 1 << 16))
    return named.repartition(count, "file").mapInArrow(lambda batches: _batched(_in_order(batches, folder), digests), DIGESTS if digests else IDS)


def _located(batches, folder: str):
    for batch in batches:
        for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            index = read_index(folder, file)
            n = len(index) - 1
            columns = [pa.array([file] * n, pa.string()), pa.array(index[:-1, 0]), pa.array(np.diff(index[:, 0])), pa.array(first + index[:-1, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "size", "start"])


def _jumping(batches, folder: str):
    store, base = fs.FileSystem.from_uri(folder)
    held: dict[str, object] = {}
    try:
        for batch in batches:
            for file, offset, size, start in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if file not in held:
                    if len(held) >= 64:
                        held.pop(next(iter(held))).close()
                    held[file] = store.open_input_file(f"{base}/{file}.rec")
                held[file].seek(offset)
                payload = read_frame(pa.BufferReader(held[file].read(size)))
                if payload is None:
                    raise Damaged(f"{file} ends before a record of its index")
                doc_id, ids = parsed(payload)
                yield doc_id, start, ids
    finally:
        for f in held.values():
            f.close()


def read_shuffled(spark: SparkSession, folder: str, seed: int, *, digests: bool = False) -> DataFrame:
    """Every record once, in an order drawn by ``seed``: the indexes are shuffled, the records are read where they lie."""
    entries = files(spark, folder).select("file", "first").mapInArrow(lambda batches: _located(batches, folder), "file string, offset long, size long, start long")
    drawn = F.xxhash64(F.lit(seed), "start", "file", "offset")
    order = entries.repartitionByRange(drawn).sortWithinPartitions(drawn)
    return order.mapInArrow(lambda batches: _batched(_jumping(batches, folder), digests), DIGESTS if digests else IDS)
