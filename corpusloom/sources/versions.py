"""Versioned tables: written aside, made visible by one rename, pinned by readers.

A store is a folder with data below ``data`` and a log of numbered commits below
``commits``.  A writer puts its tables into a folder of their own; only when all are
written does it rename a commit file to the next number.  Whoever takes a number
second gets ``Conflict``, so nothing is overwritten unseen.  A writer that fails, or
an executor that is lost for good, leaves the last version as it was and a folder
that no commit names; ``vacuum`` removes such folders and old versions.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all of it runs on this machine.
FALLBACK = "/tmp/checkpoints/corpusloom-tables"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for tables that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or FALLBACK).rstrip("/")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """What changes when a file below the paths is added, removed or rewritten: sums over names, sizes and times; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    row = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return "/".join(map(str, row))


class Conflict(RuntimeError):
    """Someone else has committed since the version that a change was based on."""


class Log:
    """Numbered commits of JSON objects in a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _store(self):
        return self._at(self.base).getFileSystem(self._conf)

    def _names(self, folder: str) -> list:
        path = self._at(f"{self.base}/{folder}")
        return list(self._store().listStatus(path)) if self._store().exists(path) else []

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"(\d{10})\.json", s.getPath().getName()) for s in self._names("commits"))
        return sorted(int(m[1]) for m in found if m)

    def current(self) -> int:
        """The newest commit's number, 0 if there is none."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        stream = self._store().open(self._at(f"{self.base}/commits/{number:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, based_on: int, content: dict) -> int:
        """Makes content the commit after ``based_on``; Conflict if there is one already."""
        if self.current() != based_on:
            raise Conflict(f"{self.base} is at {self.current()}, not at {based_on}")
        aside, to = self._at(f"{self.base}/commits/.{uuid.uuid4().hex}"), self._at(f"{self.base}/commits/{based_on + 1:010d}.json")
        out = self._store().create(aside, False)
        out.write(json.dumps(content).encode())
        out.close()
        plain = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(plain, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store().getUri(), self._conf).rename(aside, to, how)
        except Py4JJavaError as e:
            self._store().delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.base}: {based_on + 1} was committed meanwhile") from e
            raise
        return based_on + 1

    def remove(self, path: str) -> None:
        self._store().delete(self._at(f"{self.base}/{path}"), True)

    def vacuum(self, folders: Callable[[dict], Iterable[str]], keep: int, older_than: float) -> list[str]:
        """Removes all but the last commits, and the folders of data that those don't name and that are older than so many seconds."""
        numbers = self.numbers()
        held = {folder for n in numbers[-keep:] for folder in folders(self.read(n))}
        for n in numbers[:-keep]:
            self.remove(f"commits/{n:010d}.json")
        each = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._names("data")]
        gone = [name for name, at in each if name not in held and at <= time.time() - older_than]
        for name in gone:
            self.remove(f"data/{name}")
        return gone


class Versions:
    """Tables that are replaced together."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.log = spark, Log(spark, base)

    def current(self) -> int:
        return self.log.current()

    def open(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the newest if none is named; later commits don't change what was opened."""
        folder = self.log.read(version or self.current())["folder"]
        return self.spark.read.parquet(f"{self.log.base}/data/{folder}/{name}")

    def save(self, tables: dict[str, DataFrame], *, based_on: int | None = None, check=lambda: True) -> int | None:
        """Writes all tables, then commits them as one version, if ``check()`` still holds; returns its number.

        based_on: the version that the tables were made from (default: the newest as writing begins).
        """
        before = self.current() if based_on is None else based_on
        folder = f"{before + 1:010d}-{uuid.uuid4().hex}"
        try:
            for name, table in tables.items():
                table.write.parquet(f"{self.log.base}/data/{folder}/{name}")
            if check():
                return self.log.commit(before, {"folder": folder, "tables": sorted(tables)})
            self.log.remove(f"data/{folder}")
            return None
        except BaseException:
            self.log.remove(f"data/{folder}")
            raise

    def vacuum(self, keep: int = 2, *, older_than: float = 7 * 86400) -> list[str]:
        """Removes all but the last versions, and folders without a commit that are older than so many seconds."""
        return self.log.vacuum(lambda content: [content["folder"]], keep, older_than)


@dataclass(frozen=True)
class Saved:
    """What a replace-all save did; version is None, and failures has rows, if nothing was replaced."""

    version: int | None
    written: int
    failed: int
    removed: int
    failures: DataFrame


def replace_all(store: Versions, records: DataFrame, violation: Column, *, key: str, name: str = "records", based_on: int | None = None) -> Saved:
    """Replaces all records, or none: one that breaks a rule, or fails to be written, keeps the old version.

    What the new version no longer has is gone with it; ``removed`` counts those keys.  Rules are judged
    in the pass that writes.  ``failures`` are the faulty records with their ``violation``.
    """
    before = store.current() if based_on is None else based_on
    seen = Observation()
    marked = records.withColumn("violation", violation)
    watched = marked.observe(seen, F.count(F.lit(1)).alias("n"), F.count("violation").alias("failed"))
    version = store.save({name: watched.drop("violation")}, based_on=before, check=lambda: seen.get["failed"] == 0)
    counts = seen.get
    removed = 0
    if version and before:
        removed = store.open(name, before).select(key).distinct().join(store.open(name, version).select(key), key, "left_anti").count()
    return Saved(version, counts["n"] if version else 0, counts["failed"], removed, marked.where("violation IS NOT NULL"))


def put(store: Versions, rows: DataFrame, *, key: str, name: str = "records", based_on: int | None = None) -> int | None:
    """A version in which rows replace those of their keys, or are added; rows without a key are added."""
    before = store.current() if based_on is None else based_on
    if not before:
        return store.save({name: rows}, based_on=before)
    old = store.open(name, before)
    return store.save({name: old.join(rows.select(key), key, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))}, based_on=before)


def delete(store: Versions, keys: DataFrame, *, key: str, name: str = "records", enabled: bool = False, based_on: int | None = None) -> int | None:
    """A version without the rows of some keys; nothing is ever deleted unless that is enabled."""
    before = store.current() if based_on is None else based_on
    if not enabled or not before:
        return before or None
    old = store.open(name, before)
    return store.save({name: old.join(keys.select(key), key, "left_anti").select(*old.columns)}, based_on=before)
