"""A search index that follows its table: segments, tombstones, sums.

An update compares every document's digest with the one it was indexed with.  Only
new and changed documents are tokenised, into a segment of their own; changed and
deleted ones get a tombstone for the segment that holds them.  The numbers of
documents and the fields' sizes are kept as sums, to which a segment adds and from
which a tombstone takes, so scores equal those of an index built anew.  Segments and
tombstones become visible by one commit (see ``sources.versions``); ``compact`` merges
small segments and drops what is dead in them, and may run beside updates: who commits
second starts again.

Rows of one id are one document; a null id is an id of its own.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.sources.versions import Conflict, Log

#: Part of every index's path; raised when what lies there is laid out otherwise.
LAYOUT = 1
EMPTY = {"segments": {}, "dead": [], "fields": {}, "total": 0, "source": None}
TRIES = 5
#: Bytes of text that one task cuts into postings, and postings that one task merges: more input gives more tasks, not larger ones.
PART_BYTES, PART_ROWS = 4 << 20, 1 << 20
SIZES = "map<string,int>"


class SegmentIndex:
    def __init__(self, spark: SparkSession, base: str, fields: dict[str, float]):
        self.spark, self.fields = spark, fields
        self.log = Log(spark, f"{base.rstrip('/')}-{LAYOUT}")

    def state(self) -> tuple[int, dict]:
        number = self.log.current()
        return number, (self.log.read(number) if number else EMPTY)

    def _path(self, *parts: str) -> str:
        return "/".join((self.log.base, "data", *parts))

    def _read(self, names: list[str], part: str, schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*(self._path(n, part) for n in names))

    def _dead(self, state: dict, id_type: str) -> DataFrame:
        return self._read(state["dead"], "dead", f"id {id_type}, segment string")

    def documents(self, state: dict, id_type: str) -> DataFrame:
        """(id, digest, sizes, segment) of all living documents."""
        held = self._read(sorted(state["segments"]), "docs", f"id {id_type}, digest string, sizes {SIZES}, segment string")
        return _without(held, self._dead(state, id_type)) if state["dead"] else held

    def update(self, rows: DataFrame, *, id: str = "id", digest: Column | None = None, whole: bool = True, source: str | None = None) -> dict:  # noqa: A002
        """Brings the index up to date with rows (an id and the fields); returns what changed.

        digest: what changes with a document's fields (default: a hash of them; a stored one spares reading them).
        whole: rows are all there are, so documents that they lack are deleted.  source: kept with the commit.
        """
        for _ in range(TRIES - 1):
            try:
                return self._updated(rows, id, digest, whole, source)
            except Conflict:
                continue
        return self._updated(rows, id, digest, whole, source)

    def _updated(self, rows: DataFrame, id: str, digest: Column | None, whole: bool, source: str | None) -> dict:  # noqa: A002
        number, state = self.state()
        id_type = rows.schema[id].dataType.simpleString()
        own = F.sha2(F.to_json(F.struct(*(F.col(f).cast("string").alias(f) for f in self.fields))), 256) if digest is None else digest
        size = reduce(add, (F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)).cast("long") for f in self.fields))
        each = rows.select(F.col(id).alias("id"), own.alias("digest"), size.alias("bytes")).groupBy("id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"), F.sum("bytes").alias("bytes"))
        name = uuid.uuid4().hex
        here, there = each.alias("n"), self.documents(state, id_type).alias("o")
        met = here.join(there, F.col("n.id").eqNullSafe(F.col("o.id")), "full_outer")
        isnt = F.col("n.digest").isNotNull() & ~F.coalesce(F.col("n.digest") == F.col("o.digest"), F.lit(False))
        lost = F.col("o.digest").isNotNull() & (isnt | (F.col("n.digest").isNull() if whole else F.lit(False)))
        fresh, old = F.struct(F.col("n.id").alias("id"), F.col("n.digest").alias("digest"), F.col("n.bytes").alias("bytes")), F.struct("o.id", "o.segment", "o.sizes")
        if state["segments"]:
            found = met.where(isnt | lost).select(F.when(isnt, fresh).alias("fresh"), F.when(lost, old).alias("old"))
        else:
            found = here.select(fresh.alias("fresh"), F.lit(None).cast(f"struct<id:{id_type},segment:string,sizes:{SIZES}>").alias("old"))
        found.write.parquet(self._path(name, "changes"))
        changes = self.spark.read.parquet(self._path(name, "changes"))
        counts = changes.agg(F.count("fresh").alias("fresh"), F.count("old").alias("old"), F.count_if(F.col("fresh").isNotNull() & F.col("old").isNotNull()).alias("changed"), F.coalesce(F.sum("fresh.bytes"), F.lit(0)).alias("bytes")).first()
        report = {"added": counts.fresh - counts.changed, "changed": counts.changed, "deleted": counts.old - counts.changed}
        new = {"segments": dict(state["segments"]), "dead": list(state["dead"]), "fields": {f: list(v) for f, v in state["fields"].items()}, "total": state["total"], "source": source}
        if counts.fresh:
            ids = changes.where("fresh IS NOT NULL").select(F.col("fresh.id").alias("id"), F.col("fresh.digest").alias("digest"))
            chosen = rows.withColumnRenamed(id, "id")
            if state["segments"]:  # else every one is new
                chosen = chosen.join(ids.select(F.col("id").alias("__id")), F.col("id").eqNullSafe(F.col("__id")), "left_semi")
            parts = max(-(-counts.bytes // PART_BYTES), min(self.spark.sparkContext.defaultParallelism, 1 + (counts.bytes >> 20)))
            self._segment(name, search.postings(chosen, self.fields, parts=parts), ids)
            new["segments"][name] = counts.fresh
            self._add(new, self._read([name], "docs", ""), 1)
        if counts.old:
            dead = changes.where("old IS NOT NULL").select("old.*")
            dead.select("id", "segment").write.parquet(self._path(name, "dead"))
            new["dead"].append(name)
            self._add(new, dead, -1)
        if counts.fresh or counts.old or new != state:
            self.log.commit(number, new)
        return report

    def _segment(self, name: str, postings: DataFrame, ids: DataFrame) -> None:
        """Postings are written where they are, dealt by id, a file sorted by term each: dealt by term, what all documents say would go to one task."""
        ordered = postings.withColumn("segment", F.lit(name)).sortWithinPartitions("term")
        ordered.write.parquet(self._path(name, "postings"))
        self._derived(name, ids)

    def _derived(self, name: str, ids: DataFrame) -> None:
        written = self._read([name], "postings", "")
        written.select("term").distinct().write.parquet(self._path(name, "terms"))
        said, unlike = lambda f: F.when(F.col("field") == f, F.col("size")), F.raise_error(F.lit("an id has rows of unlike size"))
        ends = written.groupBy(F.col("id").alias("__id")).agg(*(end(said(f)).alias(f"{end.__name__}_{i}") for i, f in enumerate(sorted(self.fields)) for end in (F.min, F.max)))
        one = lambda i: F.when(F.col(f"min_{i}") < F.col(f"max_{i}"), unlike.cast("int")).otherwise(F.col(f"min_{i}"))
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), one(i).alias("size")) for i, f in enumerate(sorted(self.fields))))
        sizes = ends.select("__id", F.map_from_entries(F.filter(pairs, lambda x: x["size"].isNotNull())).alias("sizes"))
        docs = ids.select("id", "digest").join(sizes, F.col("id").eqNullSafe(F.col("__id")), "left").select("id", "digest", F.coalesce("sizes", F.create_map().cast(SIZES)).alias("sizes"), F.lit(name).alias("segment"))
        docs.write.parquet(self._path(name, "docs"))

    @staticmethod
    def _add(state: dict, docs: DataFrame, sign: int) -> None:
        state["total"] += sign * docs.where(F.size("sizes") > 0).count()
        for row in docs.select(F.explode("sizes").alias("field", "size")).groupBy("field").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect():  # a row per field
            n, size = state["fields"].get(row.field, (0, 0))
            state["fields"][row.field] = [n + sign * row.n, size + sign * row["size"]]

    def open(self) -> search.Index:
        """The index as it is now, to be searched; later commits don't change it."""
        _, state = self.state()
        names = sorted(state["segments"])
        if not names:
            postings = self.spark.createDataFrame([], "id long, field string, boost double, size int, term string, tf long, segment string")
            return search.index_of(postings.drop("segment"))
        postings = self._read(names, "postings", "")
        if state["dead"]:
            postings = _without(postings, self._dead(state, postings.schema["id"].dataType.simpleString()))
        sums = [(f, size / n, state["total"]) for f, (n, size) in sorted(state["fields"].items()) if n]
        fields = self.spark.createDataFrame(sums, "field string, mean double, total long")
        parts = max(self.spark.sparkContext.defaultParallelism, sum(size for _, size in state["fields"].values()) // PART_ROWS)
        return search.Index(postings.drop("segment"), self._read(names, "terms", "").distinct(), fields, parts)

    def compact(self, at_least: int = 4) -> list[str]:
        """Merges the small segments, if there are so many that each is at most twice as large as all smaller ones together; returns their names."""
        number, state = self.state()
        by_size = sorted(state["segments"].items(), key=lambda s: (s[1], s[0]))
        chosen, held = [], 0
        for name, n in by_size:
            if held and n > 2 * held:
                break
            chosen.append(name)
            held += n
        if len(chosen) < at_least:
            return []
        name = uuid.uuid4().hex
        id_type = self._read(chosen, "docs", "").schema["id"].dataType.simpleString()
        dead = self._dead(state, id_type)
        live = lambda part: _without(self._read(chosen, part, ""), dead)
        parts = -(-self._read(chosen, "postings", "").count() // PART_ROWS)
        self._segment(name, live("postings").drop("segment").repartition(max(parts, 1), "id"), live("docs"))
        rest = dead.where(~F.col("segment").isin(chosen))
        rest.write.parquet(self._path(name, "dead"))
        kept = {n: size for n, size in state["segments"].items() if n not in chosen}
        n = self._read([name], "docs", "").count()
        self.log.commit(number, state | {"segments": kept | ({name: n} if n else {}), "dead": [name] if self._read([name], "dead", "").limit(1).count() else []})
        return chosen

    def vacuum(self, keep: int = 2, *, older_than: float = 7 * 86400) -> list[str]:
        """Removes all but the last commits, and segments and tombstones that those don't name and that are older than so many seconds."""
        return self.log.vacuum(lambda state: [*state["segments"], *state["dead"]], keep, older_than)


def _without(rows: DataFrame, dead: DataFrame) -> DataFrame:
    gone = dead.select(F.col("id").alias("__id"), F.col("segment").alias("__segment"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("segment") == F.col("__segment")), "left_anti")
