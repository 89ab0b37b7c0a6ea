"""Corpora in files: XML records, snapshots, ledgers, imports, backups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "struct<id:string,author:string,testo:string,createdAt:string>"
LEDGER = f"entryId string, entryLabel string, status string, createdAt string, resolvedAt string, notes array<{NOTE}>"
BUGS = "id string, author string, testo string, status string, createdAt string, resolvedAt string"


def raw_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(file, xml, sha256) of the folder's .xml files; names that start with _ are left out."""
    files = spark.read.option("pathGlobFilter", "*.xml").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml"), F.sha2("value", 256).alias("sha256"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, modified) without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def named_file(docs: DataFrame, name: str) -> DataFrame:
    """The file of a name, after characters that no name has became _."""
    import re

    return docs.where(F.col("file") == re.sub(r"[^a-zA-Z0-9._-]", "_", name))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml) of a JSON snapshot {generatedAt, files}."""
    text = spark.read.text(path, wholetext=True)
    return files_of(text, "value")


def files_of(rows: DataFrame, json: str) -> DataFrame:
    parsed = rows.select(F.from_json(F.col(json), "generatedAt string, files map<string,string>").alias("s"))
    return parsed.select(F.explode("s.files").alias("file", "xml"))


def write_snapshot(docs: DataFrame, path: str) -> None:
    """One JSON line per file, so that no task holds the corpus; read_lines reads it."""
    docs.select("file", "xml").write.mode("overwrite").json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("multiLine", True).json(path)


def bugs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUGS).option("multiLine", True).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def tolerant(spark: SparkSession, path: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON files that hold an array of objects each.

    A file that can't be read as JSON, or holds something else than an array, gives no rows but an error (file,
    reason); elements that aren't objects are errors of their own; a path that doesn't exist gives neither.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], fields), spark.createDataFrame([], "file string, reason string")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"), F.try_parse_json("value").alias("json"))
    kind = F.schema_of_variant("json")
    reason = F.when(F.col("value").rlike(r"^\s*$"), "empty").when(F.col("json").isNull(), "not JSON").when(~F.startswith(kind, F.lit("ARRAY")), "not an array")
    judged = files.select("file", "value", reason.alias("reason"))
    element = judged.where("reason IS NULL").select("file", F.posexplode(F.from_json("value", "array<string>")).alias("n", "element"))
    is_object = F.startswith(F.ltrim("element"), F.lit("{"))
    rows = element.where(is_object).select(F.from_json("element", fields).alias("r")).select("r.*")
    faults = judged.where("reason IS NOT NULL").select("file", "reason")
    odd = element.where(~F.coalesce(is_object, F.lit(False))).select("file", F.concat(F.lit("element "), F.col("n"), F.lit(" is no object")).alias("reason"))
    return rows, faults.unionByName(odd)


def tolerant_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return tolerant(spark, path, LEDGER)


def tolerant_bugs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return tolerant(spark, path, BUGS)


def docs_or_legacy(spark: SparkSession, folder: str, legacy: str) -> DataFrame:
    """(file, xml, sha256) of the folder's records; of the one legacy file while the folder has none; else nothing."""
    empty = spark.createDataFrame([], "file string, xml string, sha256 string")
    docs = raw_docs(spark, folder) if _exists(spark, folder) else empty
    if docs.select("file").where(~F.startswith("file", F.lit("_"))).limit(1).count():
        return docs
    if not _exists(spark, legacy):
        return empty
    whole = spark.read.text(legacy, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml"), F.sha2("value", 256).alias("sha256"))


def _judged(batches) -> Iterator[pa.RecordBatch]:
    from xml.parsers import expat

    def fault(text: str | None):
        parser = expat.ParserCreate()
        try:
            parser.Parse(text or "", True)
        except (expat.ExpatError, ValueError) as e:
            return str(e).split(":")[0], getattr(e, "lineno", 1), getattr(e, "offset", 0)
        return None, None, None

    for batch in batches:
        reason, line, column = zip(*(fault(x.as_py()) for x in batch.column(1)), strict=True) if batch.num_rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reason, pa.string()), pa.array(line, pa.int64()), pa.array(column, pa.int64())], [batch.schema.names[0], "reason", "line", "column"])


def well_formed(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, reason, line, column): why and where an XML text isn't well-formed, nulls if it is; lines from 1, columns from 0.

    Texts stream through the standard parser in Arrow batches.  A null or empty text has no element.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([docs.schema[key], StructField("reason", StringType()), StructField("line", LongType()), StructField("column", LongType())])
    return docs.select(key, F.col(xml).cast("string")).mapInArrow(_judged, schema)


def savable(docs: DataFrame, key: str, xml: str) -> tuple[DataFrame, DataFrame]:
    """(documents that parse, the others with reason, line and column): the gate before a save."""
    judged = well_formed(docs, key, xml).withColumnRenamed(key, "__key")
    marked = docs.join(judged, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    return marked.where("reason IS NULL").select(*docs.columns), marked.where("reason IS NOT NULL")


# The head and the end of the cumulative backup.
BACKUP_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<?xml-model href="http://epidoc.stoa.org/schema/latest/tei-epidoc.rng" schematypens="http://relaxng.org/ns/structure/1.0"?>\n'
    '<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">\n'
)
BACKUP_END = "</teiCorpus>"
COPIED = 1 << 20


def one_file(spark: SparkSession, entries: DataFrame, key: str, text: str, path: str, *, head: str = "", end: str = "") -> int:
    """Writes head, every text in the order of its key with a line feed, and end, to one file; returns its bytes.

    The entries are range-partitioned and written as parts side by side.  On HDFS the file system joins the parts; on
    a file system that is mounted everywhere each part is copied to its place (the sum of the sizes before it), again
    side by side.  No task, and not the driver, holds more than a buffer.  The file appears under its name when it
    is complete.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    store = at(path).getFileSystem(conf)
    aside = f"{path}.{uuid.uuid4().hex}"
    entries.select(key, text).repartitionByRange(key).sortWithinPartitions(key).select(text).write.text(f"{aside}.parts")
    for name, said in (("0-head", head), ("2-end", end)):
        out = store.create(at(f"{aside}.parts/_{name}"), True)
        out.write(said.encode())
        out.close()
    parts = sorted((s.getPath().toString(), s.getLen()) for s in store.listStatus(at(f"{aside}.parts")) if s.getPath().getName().startswith("part-"))
    every = [(f"{aside}.parts/_0-head", len(head.encode())), *parts, (f"{aside}.parts/_2-end", len(end.encode()))]
    total = sum(size for _, size in every)
    if store.getScheme() == "hdfs":
        named = spark.sparkContext._gateway.new_array(at, len(every) - 1)
        for i, (part, _) in enumerate(every[1:]):
            named[i] = at(part)
        store.concat(at(every[0][0]), named)
        joined = at(every[0][0])
    elif store.getScheme() == "file":
        _put_together(spark, every, _local(aside), total)
        joined = at(aside)
    else:
        store.delete(at(f"{aside}.parts"), True)
        raise ValueError(f"{store.getScheme()} can't join files; leave the parts")
    store.delete(at(path), False)
    store.rename(joined, at(path))
    store.delete(at(f"{aside}.parts"), True)
    return total


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def _put_together(spark: SparkSession, parts: list[tuple[str, int]], target: str, total: int) -> None:
    with open(target, "wb") as f:
        f.truncate(total)
    rows, before = [], 0
    for part, size in parts:  # a row per part
        rows.append((_local(part), before))
        before += size

    def copied(batches):
        n = 0
        for batch in batches:
            for source, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(source, "rb") as f, open(target, "r+b") as out:
                    out.seek(offset)
                    while data := f.read(COPIED):
                        n += out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    listed = spark.createDataFrame(rows, "part string, before long").repartition(max(1, min(len(rows), 1 << 12)), "part")
    if listed.mapInArrow(copied, "n long").agg(F.sum("n")).first()[0] != total:
        Path(target).unlink()
        raise OSError(f"{target} was not copied whole")


def tei_block(xml: Column) -> Column:
    """A file's record as the backup has it: indented, without what stands before and after; empty if there is none."""
    block = F.regexp_extract(xml, r"(?s)<TEI.*</TEI>", 0)
    return F.when(block != "", F.concat(F.lit("  "), F.replace(block, F.lit("\n"), F.lit("\n  ")))).otherwise("")


def backup_file(docs: DataFrame, path: str, key: str = "file", xml: str = "xml") -> int:
    """The cumulative backup: one file, records in the order of their files' names."""
    kept = docs.select(F.col(key), tei_block(F.col(xml)).alias("block")).where(~F.startswith(F.col(key), F.lit("_")) & (F.col("block") != ""))
    return one_file(docs.sparkSession, kept, key, "block", path, head=BACKUP_HEAD, end=BACKUP_END)


def snapshot_file(docs: DataFrame, path: str, generated: str) -> int:
    """The snapshot {generatedAt, files} as one JSON file, an entry a line, in the order of names; ``snapshot`` reads it."""
    import json

    first = docs.agg(F.min("file")).first()[0]
    entry = F.to_json(F.create_map("file", "xml"))
    line = F.concat(F.when(F.col("file") == F.lit(first), "").otherwise(","), F.substr(entry, F.lit(2), F.length(entry) - 2))
    return one_file(docs.sparkSession, docs.select("file", line.alias("line")), "file", "line", path, head='{"generatedAt": ' + json.dumps(generated) + ', "files": {\n', end="}}")


def sniffed(rows: DataFrame, content: str) -> DataFrame:
    """Adds format: json where the text opens with a bracket or its name says so, else xml."""
    is_json = F.col(content).rlike(r"^\s*[\[{]")
    if "filename" in rows.columns:
        is_json = is_json | F.endswith("filename", F.lit(".json"))
    return rows.withColumn("format", F.when(is_json, "json").otherwise("xml"))


def blocks(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, block): each file's text indented for the cumulative backup."""
    return docs.select(key, F.regexp_replace(F.concat(F.lit("  "), F.col(xml)), "\n", "\n  ").alias("block"))


def write_backup(docs: DataFrame, path: str, key: str = "file", xml: str = "xml") -> None:
    """The backup as text files whose names and lines follow the files' order."""
    blocks(docs, key, xml).repartitionByRange(key).sortWithinPartitions(key).select("block").write.mode("overwrite").text(path)


def write_records(records: DataFrame, path: str, by: str | None = None) -> None:
    """Parsed once, kept as Parquet, so that filters and columns are pushed to the scan."""
    writer = records.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
