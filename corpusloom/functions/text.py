"""Column functions over text, kept inside generated code (no Python at run time)."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "[̀-ͯ]"
_MARKS = "".join(map(chr, range(0x300, 0x370)))
ROMAN = ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


@cache
def accent_table() -> tuple[str, str]:
    """Characters that decompose to one base character and combining marks, and their bases."""
    pairs = []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents; a final sigma equals any other.  Plain ASCII is only lower-cased."""
    source, target = accent_table()
    bare = F.translate(c, f"{source}ς{_MARKS}", f"{target}σ")  # marks have no counterpart, so they go
    return F.lower(F.when(F.octet_length(c) == F.char_length(c), c).otherwise(bare))


def fold_spaced(c: Column) -> Column:
    """Folded, with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def strip_tags(c: Column, to: str = "") -> Column:
    """Text without tags; for an index tags become spaces, for display nothing."""
    bare = F.regexp_replace(c, "<[^>]+>", to)
    return F.trim(F.regexp_replace(bare, r"\s+", " ")) if to else bare


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_xml(c: Column, *, ampersand_first: bool = True) -> Column:
    """Entities to characters; with the ampersand first, ``&amp;lt;`` becomes ``<``, else ``&lt;``."""
    amp = [("&amp;", "&")]
    rest = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
    for a, b in (amp + rest) if ampersand_first else (rest + amp):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_placeholder(c: Column) -> Column:
    """Empty, or the word that stands for what is still to be filled in."""
    return F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("", "DA_COMPILARE")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def entry_id(c: Column) -> Column:
    """A safe key: no accents, other runs than letters, digits and _ as one -, at most 128 characters."""
    source, target = accent_table()
    bare = F.regexp_replace(F.translate(c, source, target), MARKS, "")
    key = F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9_]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(key == "", F.lit("entry")).otherwise(key), 1, 128)


def file_name(number: Column) -> Column:
    """Padded to three digits; longer numbers stay whole."""
    return F.concat(F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")), F.lit(".xml"))


def year_label(year: Column) -> Column:
    """A signed year as ``12 d.C.`` or ``12 a.C.``."""
    return F.concat(F.abs(year).cast("string"), F.when(year < 0, " a.C.").otherwise(" d.C."))


def range_label(start: Column, end: Column) -> Column:
    """Both years, one where the other is missing, zero or the same, else ``-``."""
    a, b = F.when(start != 0, year_label(start)), F.when(end != 0, year_label(end))
    return F.coalesce(F.when(start == end, a), F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" - ", a, b)), a, b, F.lit("-"))


def roman(n: Column) -> Column:
    """1 to 39 in Roman numerals, greatest sign first."""
    tens = F.repeat(F.lit("X"), F.floor(n / 10).cast("int"))
    units = F.element_at(F.array(*(F.lit(_roman(i)) for i in range(10))), (n % 10 + 1).cast("int"))
    return F.concat(tens, units)


def _roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        while n >= value:
            out, n = out + sign, n - value
    return out


def century(year: Column) -> Column:
    """1 for the years 1 to 100, and for -100 to -1."""
    return F.ceil(F.abs(year) / 100).cast("int")


def highlight(c: Column, query: str) -> Column:
    """Marks the words of a query in a text, whatever their case; connectives aren't marked."""
    import re

    words = [re.escape(w) for w in query.split() if w.lower() not in ("and", "or", "not")]
    return F.regexp_replace(c, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else c


def said(c: Column | str) -> Column:
    """The text, or null where there is none."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def record_label(number: Column, prefix: str) -> Column:
    """The prefix and a record's number, or a question mark."""
    return F.concat(F.lit(prefix + " "), F.coalesce(number.cast("string"), F.lit("?")))


def place_name(city: str = "citta", region: str = "regione") -> Column:
    """City and region in capitals, or the one that there is."""
    return F.coalesce(F.concat(said(city), F.lit(", "), F.upper(said(region))), said(city), said(region), F.lit("N/A"))


def shown_title() -> Column:
    return F.coalesce(said("titolo"), said("citta"), said("regione"), F.concat(F.lit("Scheda #"), F.col("id").cast("string")))


def draft_label(c: Column, prefix: str) -> Column:
    """Region and number of a draft's file name ``PREFIX-REGION-012_nr3``; other names as they are."""
    pattern = rf"^{prefix}-([A-Z]+)-(\d+)_nr\d+"
    return F.when(c.rlike(pattern), F.concat_ws(" ", F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2).cast("long").cast("string"))).otherwise(c)


def vocabulary_label(label: str = "label", local: str = "labelIt") -> Column:
    return F.coalesce(said(local), F.col(label))


def _labelled(key: Column, labels: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), key) if labels else F.lit(None).cast("string")


def translated(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, with a capital."""
    t = F.coalesce(_labelled(value, labels), value)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))


def iconography_text(ico: str, labels: dict[str, str]) -> Column:
    """What can be searched of an iconography: keys and their labels, and the note."""
    both = lambda k: F.array(k, _labelled(k, labels))
    figures = F.flatten(F.transform(f"{ico}.figures", lambda f: F.concat(both(f["key"]), F.array(_labelled(f["type"], labels)), F.flatten(F.transform(f["traits"], lambda t: both(t["key"]))))))
    words = F.concat(both(F.col(f"{ico}.function")), F.coalesce(figures, F.array().cast("array<string>")), F.array(f"{ico}.note"))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def bibliography_key(c: Column) -> Column:
    """``smith1990b`` as ``Smith 1990b``; an author of up to three letters in capitals."""
    author = F.regexp_extract(c, r"^([A-Za-z]+?)(\d{4})([a-z]?)$", 1)
    year = F.concat(F.regexp_extract(c, r"(\d{4})([a-z]?)$", 1), F.regexp_extract(c, r"(\d{4})([a-z]?)$", 2))
    shown = F.when(F.length(author) <= 3, F.upper(author)).otherwise(F.initcap(author))
    return F.when(author == "", c).otherwise(F.concat_ws(" ", shown, year))


def density_colour(n: Column, most: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """#rrggbb between two colours by the square root of n's share of most."""
    share = F.sqrt(n / F.greatest(most, F.lit(1)))
    parts = [F.lpad(F.lower(F.hex(F.floor(F.lit(a) + (F.lit(b - a)) * share + 0.5).cast("long"))), 2, "0") for a, b in zip(low, high, strict=True)]
    return F.concat(F.lit("#"), *parts)


def to_base64(c: Column) -> Column:
    """UTF-8 in base 64, on one line."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")


def from_base64(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")
