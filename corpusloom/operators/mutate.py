"""Merges, upserts, ids, stale writes, section differences, mirrored folders and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.catalogue import even_buckets, positions
from corpusloom.operators.search import Index, search_many


def newest(incoming: DataFrame, key: str, order: str, *, last: bool = True) -> DataFrame:
    """One row per key: the last, or the first, in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if last else F.asc(order))
    return incoming.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") == 1).drop("__nth")


def merge_overwrite(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming


def merge_append(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """All of both; what comes in gets keys of its own, from its old key and its place."""
    fresh = F.concat_ws("-", F.col(key), F.lit("copy"), F.col(order).cast("string"))
    return existing.unionByName(incoming.withColumn(key, fresh))


def keyed(key: str) -> Column:
    """Whether a row has a key; null and empty ones name nothing, so such rows never meet."""
    return F.coalesce(F.col(key).cast("string") != "", F.lit(False))


def merge_skip(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows, the first of each key that is new, and every row without a key."""
    new = incoming.where(keyed(key)).join(existing.select(key).where(keyed(key)), key, "left_anti")
    return existing.unionByName(newest(new, key, order, last=False)).unionByName(incoming.where(~keyed(key)))


def merge_replace(existing: DataFrame, incoming: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows take the values of the last incoming one of their key, but for the columns ``keep``.

    Rows of new keys, and those without a key, are added, all of them.
    """
    last = newest(incoming.where(keyed(key)), key, order)
    value = lambda c: F.col(f"o.{c}") if c in (key, *keep) else F.when(F.col("n.__here"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    replaced = existing.alias("o").join(last.withColumn("__here", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    added = incoming.join(existing.select(key).where(keyed(key)), key, "left_anti")
    return replaced.select(*(value(c).alias(c) for c in existing.columns)).unionByName(added)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Field by field: an incoming value that is present wins."""
    old, new = existing.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in existing.columns))


def assign_ids(records: DataFrame, order: str, *, id: str = "id") -> DataFrame:  # noqa: A002
    """Ids that aren't positive become the greatest id plus the row's place among them."""
    lacking = records.where(F.coalesce(F.col(id), F.lit(0)) <= 0)
    most = records.agg(F.coalesce(F.greatest(F.max(id), F.lit(0)), F.lit(0)).alias("__most"))
    numbered = positions(lacking, even_buckets(lacking, order), order, name="__place").join(F.broadcast(most))  # one row
    filled = numbered.withColumn(id, F.col("__most") + F.col("__place")).drop("__most", "__place")
    return records.where(F.col(id) > 0).unionByName(filled)


def renumbered(records: DataFrame, *, id: str = "id") -> DataFrame:  # noqa: A002
    """Ids become places in the order of the old ids, kept as old_id."""
    old = records.withColumnRenamed(id, "old_id")
    return positions(old, even_buckets(old, "old_id"), "old_id", name=id)


def staleness(current: DataFrame, saves: DataFrame, key: str, digest: str, base: str) -> DataFrame:
    """(key, status) of each save: missing, unknown (no base), stale or ok."""
    joined = saves.select(key, base).join(current.select(key, digest), key, "left")
    status = F.when(F.col(digest).isNull(), "missing").when(F.col(base).isNull(), "unknown").when(F.col(base) != F.col(digest), "stale").otherwise("ok")
    return joined.select(key, status.alias("status"))


def section_diff(before: DataFrame, after: DataFrame, key: str, sections: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, changed): which sections of a record differ, null being equal to null only."""
    joined = before.alias("o").join(after.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))

    def differs(fields: tuple[str, ...]) -> Column:
        same = [F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) for f in fields]
        out = ~same[0]
        for s in same[1:]:
            out = out | ~s
        return out

    names = F.array_compact(F.array(*(F.when(differs(fields), F.lit(name)) for name, fields in sections.items())))
    return joined.select(F.col(f"o.{key}").alias(key), F.array_join(names, ",").alias("changed")).where("changed != ''")


def mirror_deletes(local: DataFrame, remote: DataFrame, skipped: DataFrame, *, confirmed: bool, name: str = "file") -> DataFrame:
    """Local files that the remote no longer has; none if its listing wasn't confirmed."""
    gone = local.select(name).join(remote.select(name), name, "left_anti").join(skipped.select(name), name, "left_anti")
    return gone if confirmed else gone.where(F.lit(False))


def draft_matches(drafts: DataFrame, corpus: DataFrame, name: str) -> DataFrame:
    """Drafts with whether the corpus has a file of that name."""
    known = corpus.select(name).distinct().withColumn("__known", F.lit(True))
    return drafts.join(known, name, "left").withColumn("has_match", F.coalesce("__known", F.lit(False))).drop("__known")


def ledger(rows: DataFrame, key: str, *, label: str, status: str, created: str, resolved: str, note: str) -> DataFrame:
    """One entry per key from flat rows: notes by time, open if any is, first created, last resolved.

    The label is the last non-empty one.
    """
    notes = F.array_sort(F.collect_list(F.struct(F.col(created).alias("at"), F.col(note).alias("note"))))
    is_open = F.bool_or(F.col(status) == "open")
    return rows.groupBy(key).agg(
        F.when(is_open, "open").otherwise("resolved").alias("status"),
        F.min(created).alias("created"),
        F.when(~is_open, F.max(resolved)).alias("resolved"),
        F.coalesce(F.max_by(label, F.when(F.col(label) != "", F.col(created))), F.col(key).cast("string")).alias("label"),
        F.count("*").alias("n_notes"),
        F.array_join(F.transform(notes, lambda x: x["note"]), "\n").alias("notes"),
    )


def cross_references(notes: DataFrame, records: DataFrame, *, text: str, key: str) -> DataFrame:
    """(key, ref, known): the @numbers of each note, and whether there is such a record."""
    refs = notes.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"@(\d{1,18})"), F.lit(1)))).alias("ref"))
    there = records.select(F.col("id").cast("long").alias("__id")).distinct()
    return refs.select(key, F.col("ref").cast("long").alias("ref")).join(there, F.col("ref") == F.col("__id"), "left").select(key, "ref", F.col("__id").isNotNull().alias("known"))


def tags(notes: DataFrame, *, text: str, key: str) -> DataFrame:
    """(key, tag): the #words of each note, once each; a tag is searched for as its word."""
    return notes.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"#[A-Za-z0-9_]+"), F.lit(0)))).alias("tag"))


def tag_hits(notes: DataFrame, index: Index, *, text: str, key: str) -> DataFrame:
    """(tag, id, score, n_words): the records that each tag of the notes finds, all tags in one join with the index."""
    each = tags(notes, text=text, key=key).select("tag").distinct()
    return search_many(index, each, "tag", "tag").withColumnRenamed("query", "tag")


def ledger_of_record(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger entries joined to the record of that entry id, of several the one of least number, else of that number."""
    by_entry = records.where(keyed("entryId")).groupBy(F.col("entryId").alias("__e")).agg(F.min("id").alias("__id1"))
    by_number = records.select(F.col("id").cast("string").alias("__n"), F.col("id").alias("__id2")).distinct()
    found = entries.join(by_entry, F.col("entryId") == F.col("__e"), "left").join(by_number, F.col("entryId") == F.col("__n"), "left")
    return found.withColumn("record_id", F.coalesce("__id1", "__id2")).drop("__e", "__n", "__id1", "__id2")


def note_appended(notes: DataFrame, note: DataFrame) -> DataFrame:
    """The flat notes of a ledger with new ones, each of which opens its entry again; ``ledger`` sums them up."""
    return notes.unionByName(note.withColumn("status", F.lit("open")).withColumn("resolved", F.lit(None).cast(notes.schema["resolved"].dataType)))


def status_set(notes: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Notes with the status, and the time of resolving, that changes (key, status, at) give to their entries.

    Of several changes of an entry the last by time counts (at one time, ``resolved``); resolving anew sets a new time.
    """
    last = changes.where(keyed(key)).groupBy(F.col(key).alias("__key")).agg(F.max(F.struct("at", "status")).alias("__last"))
    joined = notes.join(last, F.col(key) == F.col("__key"), "left")
    changed = F.col("__last").isNotNull()
    status = F.when(changed, F.col("__last.status")).otherwise(F.col("status"))
    resolved = F.when(~changed, F.col("resolved")).when(F.col("__last.status") == "resolved", F.col("__last.at"))
    return joined.withColumn("status", status).withColumn("resolved", resolved).select(*notes.columns)
