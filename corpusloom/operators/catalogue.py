"""The catalogue: optional predicates in conjunction, sorting, paging, facets.

Predicates are columns, so they reach the scan where the source allows it; those
that a query leaves out aren't added at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 25


def date_contained(start: Column, end: Column, low: int, high: int) -> Column:
    """Within low..high; a record with a bound missing or 0 passes."""
    unset = start.isNull() | (start == 0) | end.isNull() | (end == 0)
    return F.coalesce(unset | ((start >= low) & (end <= high)), F.lit(True))


def date_overlapping(start: Column, end: Column, low: int, high: int) -> Column:
    """Meets low..high; a single bound is a point, a record without bounds passes."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    return F.coalesce((a <= high) & (b >= low), F.lit(True))


@dataclass(frozen=True)
class CatalogueQuery:
    """What a user may ask for; None leaves a condition out."""

    regione: str | None = None
    regioni: tuple[str, ...] = ()
    epiteti: tuple[str, ...] = ()
    citta: str | None = None
    tipo: str | None = None
    materiale: str | None = None
    iscrizione: bool | None = None
    anepigr: bool | None = None
    dates: tuple[int, int] | None = (-500, 500)
    function: str | None = None
    trait: str | None = None
    place: str | None = None
    translated: bool | None = None

    def predicates(self) -> list[Column]:
        out = [F.col(f) == v for f in ("regione", "citta", "tipo", "materiale", "iscrizione", "anepigr") if (v := getattr(self, f)) is not None]
        if self.regioni:
            out.append(F.col("regione").isin(*self.regioni))
        if self.epiteti:  # any of them
            out.append(F.arrays_overlap("epiteti", F.array(*map(F.lit, self.epiteti))))
        if self.function is not None:
            out.append(F.col("iconografia.function") == self.function)
        if self.trait is not None:
            out.append(F.exists("iconografia.figures", lambda f: F.exists(f["traits"], lambda t: t["key"] == self.trait)))
        if self.place is not None:
            out.append(F.exists("iconografia.figures", lambda f: f["place"] == self.place))
        if self.translated is not None:
            has = F.coalesce(F.exists("traduzioni", lambda t: F.trim(t["testo"]) != ""), F.lit(False))
            out.append(has if self.translated else ~has)
        if self.dates is not None:
            out.append(date_contained(F.col("data_inizio"), F.col("data_fine"), *self.dates))
        return out

    def apply(self, records: DataFrame, hits: DataFrame | None = None) -> DataFrame:
        """The records that meet every condition, and are among hits (id) if a search is active."""
        found = self.predicates()
        kept = records.where(reduce(and_, found)) if found else records
        return kept if hits is None else kept.join(hits.select("id"), "id", "left_semi")


#: The catalogue's language: its rules sort names (accents and case after letters).
LOCALE = "it"


def collated(c: Column, locale: str | None = LOCALE) -> Column:
    """A string as it sorts, and compares, by a language's rules; None: by bytes."""
    return c if locale is None else F.collate(c, locale)


def ordered(records: DataFrame, field: str, *, ascending: bool = True, unique: str = "id", locale: str | None = LOCALE) -> DataFrame:
    """Sorted by a field, cities by region and city, names by the language's rules; equal rows by a unique column."""
    if field == "citta":
        key = F.trim(F.concat(F.coalesce("regione", F.lit("")), F.lit(" "), F.coalesce("citta", F.lit(""))))
    else:
        key = F.col(field)
    if field == "citta" or records.schema[field].dataType.typeName() == "string":
        key = collated(key, locale)
    return records.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), unique)


def suggestions(records: DataFrame, field: str, *, locale: str | None = LOCALE) -> DataFrame:
    """(value) the distinct, trimmed, non-empty values of a field in the order of a language."""
    values = records.select(F.trim(F.col(field)).alias("value")).where(F.col("value") != "").distinct()
    return values.orderBy(collated(F.col("value"), locale))


def page(records: DataFrame, number: int, *keys: Column | str, size: int = PAGE) -> DataFrame:
    """Page ``number``, from 1, of the records in order."""
    return records.orderBy(*keys).offset((number - 1) * size).limit(size)


#: Buckets of about equal numbers of rows that ``even_buckets`` makes at most.
BUCKETS = 512


def even_buckets(rows: DataFrame, field: str, most: int = BUCKETS) -> Column:
    """A bucket for ``positions`` from a numeric field: quantiles of the rows part it, however its values lie.

    The quantiles are at most ``most`` numbers; a row finds its bucket by halving them.  Nulls, which sort first, have
    a bucket of their own.
    """
    shares = [i / most for i in range(1, most)]
    cuts = sorted(set(rows.approxQuantile(field, shares, 1 / (4 * most)) or []))

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(field).cast("double") < cuts[middle], halved(low, middle)).otherwise(halved(middle + 1, high))

    return F.when(F.col(field).isNull(), -1).otherwise(halved(0, len(cuts)))


def positions(rows: DataFrame, bucket: Column, *keys: Column | str, name: str = "position") -> DataFrame:
    """rows with their place, from 1, in the order of keys.

    ``bucket`` must not fall as the keys rise.  Rows are numbered within their
    bucket; only the buckets' sizes are added up in one place, so there should be few (``even_buckets``).
    """
    held = rows.withColumn("__bucket", bucket)
    sizes = held.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys))
    return held.withColumn("__nth", nth).join(before, "__bucket").withColumn(name, F.col("__before") + F.col("__nth")).drop("__bucket", "__nth", "__before")


def facets(records: DataFrame, *fields: str) -> DataFrame:
    """(facet, value): the distinct, trimmed, non-empty values of some fields."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.trim(F.col(f)).alias("value")) for f in fields))).alias("x")
    return records.select(each).select("x.*").where(F.col("value") != "").distinct()


def nested_facets(records: DataFrame) -> DataFrame:
    """(facet, value) of the functions, figures' places and traits."""
    figures = records.select(F.explode("iconografia.figures").alias("f"))
    traits = figures.select(F.explode("f.traits").alias("t")).select(F.lit("trait").alias("facet"), F.col("t.key").alias("value"))
    places = figures.select(F.lit("place").alias("facet"), F.col("f.place").alias("value"))
    functions = records.select(F.lit("function").alias("facet"), F.col("iconografia.function").alias("value"))
    return functions.unionByName(places).unionByName(traits).where(F.col("value") != "").distinct()


def quick_filter(records: DataFrame, text: str, *fields: str, most: int = 80) -> DataFrame:
    """The first records, in order, of which a field contains a text in any case."""
    found = reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(f).cast("string")), F.lit(text.lower())) for f in fields))
    return records.where(found).orderBy("id").limit(most)


def with_status(rows: DataFrame, status: str | None) -> DataFrame:
    """Ledger entries or bugs of a status (None: all), newest first."""
    kept = rows if status is None else rows.where(F.col("status") == status)
    return kept.orderBy(F.desc("createdAt"), "id")


def drafts(rows: DataFrame, reviewed: bool | None) -> DataFrame:
    """Drafts (filename, has_match) that the corpus has, or lacks (None: all), by name."""
    kept = rows if reviewed is None else rows.where(F.col("has_match") == reviewed)
    return kept.orderBy("filename")


def completions(vocabulary: DataFrame, label: str, begun: str, chosen: Column | None = None, most: int = 30) -> DataFrame:
    """The first labels, by name, that contain what was begun, but for those chosen already."""
    found = vocabulary.select(F.col(label).alias("label")).distinct().where(F.contains(F.lower("label"), F.lit(begun.lower())))
    return (found if chosen is None else found.where(~F.array_contains(chosen, F.col("label")))).orderBy("label").limit(most)


def with_chip(chips: Column, new: str) -> Column:
    """The chosen labels and a new one, each once."""
    return F.array_union(chips, F.array(F.lit(new)))
