"""What is derived from records and editions: index suggestions, persons, functions, drill-downs, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import fold


def named(tokens: Column, name: str) -> Column:
    return F.filter(tokens, lambda t: (t["kind"] == "el") & (t["name"] == name))


def inner_text(tokens: Column, path: Column) -> Column:
    """The text below a path of a flat token list."""
    below = F.filter(tokens, lambda t: (t["kind"] == "text") & (F.size(t["path"]) > F.size(path)) & (F.slice(t["path"], F.lit(1), F.size(path)) == path))
    return F.trim(F.regexp_replace(F.array_join(F.transform(below, lambda t: t["value"]), ""), r"\s+", " "))


PERSON = "person"


def edition_index(editions: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, index, who, value) of an edition's persons, read once: suggestions (see ``index_suggestions``), and first mentions (see ``edition_persons``) below ``PERSON``."""
    rows = editions.select(key, F.col(tokens).alias("t"), F.posexplode(named(F.col(tokens), "persName")).alias("pos", "p"))
    own = F.element_at("p.attrs", "key")
    shown = F.trim(F.when(own.isNull(), inner_text(F.col("t"), F.col("p.path"))).otherwise(own))
    rows = rows.select(key, "pos", own.alias("own"), F.element_at("p.attrs", "type").alias("kind"), F.element_at("p.attrs", "xml:id").alias("xmlId"), shown.alias("label"))
    index = F.when(F.col("kind") == "divine", "divinita").when(F.col("kind") == "attested", "onomastica").when(F.col("kind").isin("ruler", "emperor"), "imperatori")
    said = F.when(index.isNotNull() & (F.col("label") != ""), F.struct(index.alias("index"), F.col("label").alias("who"), F.col("label").alias("value")))
    person = F.when(F.col("xmlId").isNotNull(), F.struct(F.lit(PERSON).alias("index"), F.col("xmlId").alias("who"), F.col("own").alias("value")))
    each = rows.select(key, "pos", F.explode(F.array_compact(F.array(said, person))).alias("x"))
    return each.groupBy(key, F.col("x.index").alias("index"), F.col("x.who").alias("who")).agg(F.min_by("x.value", "pos").alias("value"))


def index_suggestions(editions: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, index, value) that an edition's persons suggest: nested ones too, rulers and emperors alike, no aliases."""
    return edition_index(editions, key, tokens).where(F.col("index") != PERSON).select(key, "index", "value")


def edition_persons(editions: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, xmlId, personKey): the first mention of each person that has an id."""
    return edition_index(editions, key, tokens).where(F.col("index") == PERSON).select(key, F.col("who").alias("xmlId"), F.col("value").alias("personKey"))


def carried_over(derived: DataFrame, previous: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Derived rows; fields that they lack come from the previous row of the same keys."""
    old = previous.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields))
    return derived.join(old, keys, "left").select(*(F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in derived.columns))


def suggested_function(kinds: DataFrame, key: str, kind: str, position: str, vocabulary: dict[str, str], synonyms: dict[str, str]) -> DataFrame:
    """(key, function) by a record's kinds in order: the first that is in the vocabulary or contains a synonym."""
    value = F.lower(F.col(kind))
    exact = F.coalesce(*(F.when(value == k.lower(), F.lit(v)) for k, v in vocabulary.items()), F.lit(None).cast("string"))
    loose = F.coalesce(*(F.when(F.contains(value, F.lit(k.lower())), F.lit(v)) for k, v in synonyms.items()), F.lit(None).cast("string"))
    return kinds.withColumn("function", F.coalesce(exact, loose)).where("function IS NOT NULL").groupBy(key).agg(F.min_by("function", position).alias("function"))


def guessed_name(c: Column, stems: dict[str, str]) -> Column:
    """The name whose folded stem the folded text opens with."""
    return F.coalesce(*(F.when(F.startswith(fold(c), F.lit(s)), F.lit(n)) for s, n in stems.items()), F.lit(None).cast("string"))


def drill_down(records: DataFrame, **holds: str) -> DataFrame:
    """Records whose flat lists hold the given values."""
    for field, value in holds.items():
        records = records.where(F.array_contains(field, value))
    return records


def grouped_traits(records: DataFrame, key: str) -> DataFrame:
    """(key, n, type, traits): each figure's traits by type."""
    figures = records.select(key, F.explode("iconografia.figures").alias("f"))
    traits = figures.select(key, F.col("f.n").alias("n"), F.explode("f.traits").alias("t"))
    return traits.groupBy(key, "n", "t.type").agg(F.array_sort(F.collect_list("t.key")).alias("traits"))


def section_states(records: DataFrame, key: str, changed: DataFrame, sections: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, section, state): dirty where changed lists it, else present if a field says something, else absent."""
    says = lambda fields: F.coalesce(*(F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields)).isNotNull()
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("section"), says(f).alias("here")) for n, f in sections.items()))).alias("x")
    rows = records.select(key, each).select(key, "x.*").join(changed, key, "left")
    dirty = F.array_contains(F.split(F.coalesce("changed", F.lit("")), ","), F.col("section"))
    return rows.select(key, "section", F.when(dirty, "dirty").when(F.col("here"), "present").otherwise("absent").alias("state"))


def selected(records: DataFrame, ids: DataFrame, *, inverse: bool = False) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti" if inverse else "left_semi")
