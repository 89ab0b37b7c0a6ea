"""Rules on records and input: each row gets the first rule it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT, MEDIUM, LONG, FEW, MANY = 200, 10_000, 50_000, 50, 100
#: Records or files that one request may hold.
BATCH = 500


def first_violation(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that finds fault, or null; a rule that is null finds none."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules), F.lit(None).cast("string"))


def units(c: Column | str) -> Column:
    """The length in UTF-16 units, as limits count it: a character beyond U+FFFF is two."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def too_long(c: Column | str, most: int) -> Column:
    """Whether a text has more than so many units; they are counted only where its bytes allow it (never fewer than units)."""
    size, octets = F.length(c), F.octet_length(c)
    return (octets > most) & ((size > most) | ((size + (octets - size) / 3 > most) & (units(c) > most)))


def longer(field: str, most: int) -> tuple[str, Column]:
    return f"{field} longer than {most}", too_long(field, most)


def more(field: str, most: int) -> tuple[str, Column]:
    return f"{field} more than {most}", F.size(field) > most


def record_shape() -> Column:
    """The limits of a record that may be written, in the order in which they are tested."""
    short, medium = ("regione", "citta", "tipo", "materiale"), ("note_interne", "note_interne_rawXml")
    lists = {"epiteti": FEW, "divinita": FEW, "onomastica": FEW, "textTypes": FEW, "imperatori": FEW, "persone": MANY, "traduzioni": FEW, "bibliografia": FEW, "revisions": MANY}
    number = F.col("id").try_cast("double")
    rules = [("id is no number from 0", number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")) | (number < 0))]
    rules += [longer(f, SHORT) for f in short] + [longer("testo", LONG)] + [longer(f, MEDIUM) for f in medium] + [more(f, n) for f, n in lists.items()]
    rules += [longer("iconografia.function", SHORT), longer("iconografia.note", MEDIUM), more("iconografia.figures", FEW)]
    traits, place = f"traits more than {FEW}", "place longer than 50"
    fault = lambda f: F.when(F.size(f["traits"]) > FEW, F.lit(traits)).when(too_long(f["place"], 50), F.lit(place))
    first = F.get(F.array_compact(F.transform("iconografia.figures", fault)), F.lit(0))  # figure by figure
    rules += [(name, first == name) for name in (traits, place)]
    return first_violation(*rules)


def within_batch(rows: DataFrame, most: int = BATCH) -> DataFrame:
    """The rows of a request, or none with an error if there are more than it may hold."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a request holds {most} rows at most")
    return rows


def note_rules(text: str, author: str, status: str) -> Column:
    return first_violation(
        (f"{text} empty", F.trim(F.coalesce(F.col(text), F.lit(""))) == ""),
        longer(text, 4000),
        longer(author, 100),
        (f"{status} unknown", F.col(status).isNotNull() & ~F.col(status).isin("open", "resolved")),
    )


def split_valid(rows: DataFrame, violation: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without fault, the others with their violation)."""
    marked = rows.withColumn("violation", violation)
    return marked.where(F.col("violation").isNull()).drop("violation"), marked.where(F.col("violation").isNotNull())


def tally(rows: DataFrame, violation: Column) -> DataFrame:
    """(outcome, n)."""
    return rows.groupBy(F.coalesce(violation, F.lit("imported")).alias("outcome")).agg(F.count("*").alias("n"))
