"""Full-text search over fields of records: kept postings, expansion, lower-bounded BM25.

Postings are one row per record, field and term.  ``segments`` keeps them in files of
some records each, sorted by term, beside the vocabulary and the fields' sizes; a query
reads the vocabulary, and of the postings what its terms need (the scan skips pages
without them).  Terms are never dealt by: a term that all records hold is in all files.
A query's words are expanded over the vocabulary (equal, with the word as prefix,
or within an edit distance that grows with the word), then joined with the postings
by term, so neither texts nor records meet in pairs.  Scores are BM25+ with field
boosts; an expansion counts less the more it differs from the word.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, iconography_text, strip_tags

TERM = r"[\p{L}\p{N}]+"
K1, B, DELTA = 1.2, 0.7, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY = 0.375, 0.45, 0.2
#: Up to so many terms of a query are pushed to the scan of the postings, more are joined.
PUSHED = 500
#: Up to so many terms are sent to the postings (some 60 bytes each), with more both sides are dealt by term.
SENT = 200_000
#: Up to so many words of a query are counted as bits of a number.
BITS = 63

#: Field boosts of the catalogue's index: fixed values.
FIELD_BOOST = {
    "testo_searchable": 3.0, "epiteti": 2.5, "divinita": 2.5, "onomastica": 1.5, "imperatori": 1.5, "citta": 1.0, "regione": 1.0, "tipo": 1.0, "materiale": 0.5, "titolo": 1.5,
    "note_interne": 0.5, "apparatus": 0.5, "traduzioni": 1.0, "bibliografia": 0.5, "iconografia": 1.0,
}


def indexed_texts(records: DataFrame, labels: dict[str, str] | None = None, *, id: str = "id") -> DataFrame:  # noqa: A002
    """The id and the fields of the catalogue's index as one text each; what a record lacks is empty."""
    has, none = set(records.columns), F.lit("")

    def said(field: str) -> Column:
        if field == "apparatus":
            notes = F.array_join(F.transform("apparatus_entries", lambda e: e["note"]), " ") if "apparatus_entries" in has else none
            return strip_tags(F.concat_ws(" ", notes, F.col("apparatus_text") if "apparatus_text" in has else none), " ")
        if field not in has:
            return none
        if field in ("epiteti", "divinita", "onomastica", "imperatori"):
            return F.array_join(field, " ")
        if field == "traduzioni":
            return F.array_join(F.transform(field, lambda t: F.concat_ws(" ", t["testo"], t["note"])), " ")
        if field == "bibliografia":
            return F.array_join(F.transform(field, lambda t: t["titolo"]), " ")
        if field == "iconografia":
            return iconography_text(field, labels or {})
        return strip_tags(F.col(field), " ") if field == "note_interne" else F.col(field)

    return records.select(F.col(id).alias("id"), *(F.coalesce(said(f), none).alias(f) for f in FIELD_BOOST))


class Index(NamedTuple):
    """postings (id, field, boost, term, tf, size); terms (term); fields (field, mean, total: of all records that hold a term); parts: into how many its hits are dealt, if known."""

    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    parts: int | None = None


def index_of(rows: DataFrame) -> Index:
    """The parts of an index, of postings that aren't kept."""
    total = rows.select("id").distinct().agg(F.count(F.lit(1)).alias("total"))  # a null id is one too
    means = rows.select("id", "field", "size").distinct().groupBy("field").agg(F.avg("size").alias("mean"))
    return Index(rows, rows.select("term").distinct(), means.join(F.broadcast(total)))  # one row


def postings(records: DataFrame, fields: dict[str, float], *, id: str = "id", marked: bool = False, parts: int | None = None) -> DataFrame:  # noqa: A002
    """(id, field, boost, term, tf, size): size is the field's number of terms.

    Records are dealt by id while they are texts, into so many parts, so their terms are counted where they are cut.
    """
    texts = (F.struct(F.lit(f).alias("field"), (strip_tags(F.col(f), " ") if marked else F.col(f)).alias("text")) for f in fields)
    boost = F.element_at(F.create_map(*(x for f, b in fields.items() for x in (F.lit(f), F.lit(float(b))))), F.col("field"))
    said = F.explode(F.filter(F.array(*texts), lambda x: x["text"] != "")).alias("x")  # what is empty isn't folded
    rows = records.select(id, *fields).repartition(*(() if parts is None else (parts,)), id).select(F.col(id).alias("id"), said).select("id", "x.field", F.regexp_extract_all(fold(F.col("x.text")), F.lit(TERM), F.lit(0)).alias("terms"))
    rows = rows.select("id", "field", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    return rows.groupBy("id", "field", "size", "term").agg(F.count("*").alias("tf")).select("id", "field", boost.alias("boost"), "size", "term", "tf")


def expanded(vocabulary: DataFrame, words: list[str], *, prefix: bool, fuzzy: float) -> DataFrame:
    """(word, term, weight): the vocabulary's terms that each word of a query stands for; one scan."""
    term, size = F.col("term"), F.length("term")
    cases = []
    for word in words:
        weight = F.when(term == word, 1.0)
        if prefix:
            weight = weight.when(F.startswith(term, F.lit(word)), PREFIX_WEIGHT * len(word) / (len(word) + 0.3 * (size - len(word))))
        most = int(fuzzy * len(word) + 0.5)
        if most:
            distance = F.levenshtein(term, F.lit(word), most)
            weight = weight.when(F.abs(size - len(word)).between(0, most) & (distance >= 0), FUZZY_WEIGHT * len(word) / (len(word) + distance))
        cases.append(F.struct(F.lit(word).alias("word"), weight.alias("weight")))
    return vocabulary.select("term", F.explode(F.array(*cases)).alias("x")).select("x.word", "term", "x.weight").where(F.col("weight").isNotNull())


def search(index: Index, query: str, *, every: bool = False, prefix: bool = True, fuzzy: float = FUZZY) -> DataFrame:
    """(id, score, n_words): records that hold any, or every, word of the query."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query) if not 0x300 <= ord(c) <= 0x36F).replace("ς", "σ").lower()
    words = sorted(set(re.findall(r"[^\W_]+", plain)))
    if not words:
        return index.postings.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words")).where(F.lit(False))
    terms = expanded(index.terms, words, prefix=prefix, fuzzy=fuzzy)
    few = terms.limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        terms = terms.sparkSession.createDataFrame([tuple(r) for r in few], "word string, term string, weight double")
        postings, small = index.postings.where(F.col("term").isin(sorted({r.term for r in few}))), F.broadcast
    else:
        small = _sent(terms)
        postings = index.postings.join(small(terms.select("term").distinct()), "term", "left_semi")
    terms = small(terms)
    scored = _weighed(postings, index, small).join(terms, "term")
    said = F.countDistinct("word")
    if len(words) <= BITS:
        said = F.bit_count(F.bit_or(F.element_at(F.create_map(*(x for i, w in enumerate(words) for x in (F.lit(w), F.lit(1 << i).cast("long")))), F.col("word")))).cast("long")
    out = scored.groupBy("id").agg(F.sum(F.col("weight") * F.col("score")).alias("score"), said.alias("n_words"))
    return out.where(F.col("n_words") == len(words)) if every else out


def _sent(rows: DataFrame):
    """How few rows are marked, to be sent to the postings, which then stay where they are; many are left as they are."""
    return F.broadcast if rows.limit(SENT + 1).count() <= SENT else lambda x: x


def _weighed(postings: DataFrame, index: Index, small) -> DataFrame:
    """(id, term, score) of the asked postings, which are all that there are of their terms; ``small`` marks what is sent to them."""
    frequency = postings.groupBy("field", "term").agg(F.count("*").alias("df"))  # a posting is a record's only one of its field and term
    scored = postings.join(small(frequency), ["field", "term"]).join(F.broadcast(index.fields), "field")  # a row per field
    idf = F.log1p((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return scored.select("id", "term", (F.col("boost") * idf * (DELTA + part)).alias("score"))


def search_many(index: Index, queries: DataFrame, query: str, text: str, *, every: bool = False) -> DataFrame:
    """(query, id, score, n_words) of many queries at once: one join of their words with the postings.

    Words are looked for as they are, without prefixes or neighbours.  Queries of one name are one query.
    """
    words = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col(text)), F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    small = _sent(words)
    postings = index.postings.join(small(words.select("term").distinct()), "term", "left_semi")
    # Dealt by record, so that neither a common term nor a query that finds much is in one place.
    weighed = _weighed(postings, index, small).join(small(words), "term").repartition(*(() if index.parts is None else (index.parts,)), "id")
    found = weighed.groupBy("query", "id", "term").agg(F.sum("score").alias("score")).groupBy("query", "id").agg(F.sum("score").alias("score"), F.count("*").alias("n_words"))
    if not every:
        return found
    asked = words.groupBy("query").agg(F.count("*").alias("__asked"))
    return found.join(asked, "query").where("n_words = __asked").drop("__asked")


def vocabulary_lookup(rows: DataFrame, label: str, text: str, most: int = 40) -> DataFrame:
    """The first labels, by name, that contain a text but for case and accents."""
    from pyspark.sql.functions import col

    return rows.select(col(label).alias("label")).distinct().where(F.contains(fold(col(label)), fold(F.lit(text)))).orderBy("label").limit(most)


def falls_in_span(found: str, spans: str, text: str):
    """Whether a place where ``found`` occurs in text, overlapping ones too, meets one of the spans [s, e).

    Only what a span and the places that reach into it cover is looked at.
    """
    size = F.length(F.col(found))

    def inside(s: Column) -> Column:
        first = F.greatest(s["s"] - size + 1, F.lit(0))  # 0-based; a place from here on reaches into the span
        return (size > 0) & (s["e"] > s["s"]) & F.contains(F.substr(F.col(text), first + 1, s["e"] - first + size - 1), F.col(found))

    return F.exists(F.col(spans), inside)
