"""Imported records made whole: every field has a value of its kind, every record an id, an entry id and a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.catalogue import even_buckets, positions

# Fields that are texts, flags, years and lists in a record, and what isn't empty by default.
TEXTS = (
    "regione citta tipo tipo_ref materiale materialRef dim dim_altezza dim_larghezza dim_profondita dim_unita luogo_cons luogo_rit luogo_moderno place_ref_ancient place_ref_modern origPlace_nota conserv data "
    "layout_desc scrittura scrittura_ref scrittura_note tm tmLink authority facsimile_url facsimile_desc testo note_interne note_interne_rawXml"
).split()
FLAGS, YEARS = ("iscrizione", "anepigr"), ("data_inizio", "data_fine")
LISTS = ("origDates", "msIdnos", "phi", "textTypes", "epiteti", "divinita", "imperatori", "revisions", "traduzioni", "bibliografia")
DEFAULTS = {"dim_unita": "metre"}
#: A kind of text that an import leaves out.
LEFT_OUT = "iscrizione greca"
#: Other lists and the nested description are kept as they come.


def _text(records: DataFrame, field: str) -> Column:
    if field not in records.columns:
        return F.lit(DEFAULTS.get(field, ""))
    return F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit(DEFAULTS.get(field, "")))


def _list(records: DataFrame, field: str) -> Column:
    if field not in records.columns or records.schema[field].dataType.typeName() != "array":
        return F.array().cast("array<string>")
    whole = F.coalesce(F.col(field), F.array().cast(records.schema[field].dataType))
    return F.filter(whole, lambda x: F.lower(x) != LEFT_OUT) if field == "textTypes" else whole


def defaulted(records: DataFrame, existing: DataFrame, order: str, *, stamp: str = "import") -> DataFrame:
    """Imported records with all fields, in a type of their own; fields that aren't named here are kept.

    A missing id is the next free one after those of ``existing``, by ``order`` (a number, dropped at the end); a
    missing entry id comes from the stamp and the record's place in the import, a missing title from its id or place.
    The apparatus, if it is a list of (loc, note), also gives ``testo_tradotto``, a line each.
    """
    placed = positions(records, even_buckets(records, order), order, name="__place")
    lacks = F.coalesce(F.col("id") == 0, F.lit(True)) if "id" in records.columns else F.lit(True)
    placed = placed.withColumn("__lacks", lacks)
    lacking = placed.where("__lacks").select(F.col("__place").alias("__of"))
    nth = positions(lacking, even_buckets(lacking, "__of"), "__of", name="__free")
    most = existing.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(0)).cast("long").alias("__most"))
    rows = placed.join(nth, F.col("__place") == F.col("__of"), "left").join(F.broadcast(most))  # one row
    own = F.col("id").cast("long") if "id" in records.columns else F.lit(None).cast("long")
    number = F.when(F.col("__lacks"), F.col("__most") + F.col("__free")).otherwise(own)
    shown = F.when(F.col("__lacks"), F.col("__place")).otherwise(own)
    has_list = "apparatus" in records.columns and records.schema["apparatus"].dataType.typeName() == "array"
    apparatus = F.col("apparatus") if has_list else _text(records, "apparatus")
    said = F.coalesce(F.array_join(F.transform("apparatus", lambda e: F.concat_ws(": ", e["loc"], e["note"])), "\n"), F.lit("")) if has_list else _text(records, "apparatus")
    made = {
        "id": number,
        "entryId": F.coalesce(F.nullif(F.col("entryId"), F.lit("")) if "entryId" in records.columns else F.lit(None), F.concat(F.lit(f"gen-{stamp}-"), F.col("__place"))),
        "titolo": F.coalesce(F.nullif(F.col("titolo"), F.lit("")) if "titolo" in records.columns else F.lit(None), F.concat(F.lit("Scheda #"), shown)),
        **{f: _text(records, f) for f in TEXTS},
        **{f: F.coalesce(F.col(f), F.lit(False)) if f in records.columns else F.lit(False) for f in FLAGS},
        **{f: F.col(f).try_cast("double") if f in records.columns else F.lit(None).cast("double") for f in YEARS},
        **{f: _list(records, f) for f in LISTS},
        "apparatus": apparatus,
        "testo_tradotto": said,
    }
    kept = [c for c in records.columns if c not in made and c != order]
    return rows.select(*(value.alias(name) for name, value in made.items()), *kept)
