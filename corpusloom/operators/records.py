"""Records from XML text: one row per record, its fields by patterns in generated code.

Patterns take the first match, as the format's readers always have; comments count
as text.  A field that a record lacks is empty, not null, except years, dates' bounds
and ids of persons.  Only the running text of an edition needs a row helper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.markup import LINEARISED, linearise
from corpusloom.functions.text import escape_xml, is_placeholder, unescape_xml

RECORD = r"(?s)<TEI[ >].*?</TEI>"
#: Fixed values of the format: words that mark an inscription or its absence, and the kind that says nothing.
WRITTEN, UNWRITTEN, GENERIC = ("decreto", "iscrizione", "epigrafe", "onorario"), ("anepigrafe", "senza iscrizione"), "iscrizione greca"
AFTER_EDITION = r'(?=<div\s+type="(?:apparatus|translation|commentary|bibliography)"|</body>|</text>|</TEI>)'


def split_records(files: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per record of each file, with its place in the file.

    Where none is well delimited, what lies from the first opening to the last
    closing tag is one record; files without those give none.
    """
    found = F.regexp_extract_all(F.col(xml), F.lit(RECORD), F.lit(0))
    loose = F.regexp_extract(F.col(xml), r"(?s)<TEI.*</TEI>", 0)
    every = F.when(F.size(found) > 0, found).when(loose != "", F.array(loose))
    return files.select(*(c for c in files.columns if c != xml), F.posexplode(every).alias("part", "tei"))


def first(pattern: str, c: Column | str = "tei", group: int = 1) -> Column:
    return F.trim(F.regexp_extract(c, f"(?s){pattern}", group))


def every(pattern: str, c: Column | str = "tei", group: int = 1) -> Column:
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(f"(?s){pattern}"), F.lit(group))


def attr(c: Column, name: str) -> Column:
    return unescape_xml(F.regexp_extract(c, f'{name}="([^"]*)"', 1))


def filled(*columns: Column) -> Column:
    """The first that isn't empty, or null; each is read once, also where the engine shares nothing (in lists)."""
    return F.get(F.filter(F.array(*columns), lambda c: c != ""), F.lit(0))


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain(c: Column) -> Column:
    """Text without its tags."""
    return spaced(unescape_xml(F.regexp_replace(c, "<[^>]+>", "")))


def resolved(c: Column) -> Column:
    """Prose with pointers as what they point at, expansions as ``abbr(ex)`` and Greek between « and »."""
    c = F.regexp_replace(c, r'<ptr\s+[^>]*target="#?([^"]*)"[^>]*/?>', "$1")
    c = F.regexp_replace(c, r"(?s)<expan[^>]*>\s*<abbr[^>]*>([^<]*)</abbr>\s*<ex[^>]*>([^<]+)</ex>\s*</expan>", "$1($2)")
    c = F.regexp_replace(c, r"(?s)<citedRange[^>]*>(.*?)</citedRange>", "$1")
    c = F.regexp_replace(c, r'(?s)<foreign\s+[^>]*xml:lang="grc"[^>]*>(.*?)</foreign>', "«$1»")
    return spaced(F.regexp_replace(unescape_xml(c), "<[^>]+>", " "))


def paragraph(c: Column) -> Column:
    """The first paragraph of a block, or the block."""
    return resolved(F.coalesce(filled(first(r"<p>(.*?)</p>", c)), c))


def element(name: str, c: Column | str = "tei") -> Column:
    return unescape_xml(first(f"<{name}[^>]*>(.*?)</{name}>", c))


def opening(name: str, c: Column | str = "tei") -> Column:
    """The attributes of the first element of a name."""
    return first(f"<{name}([^>]*)>.*?</{name}>", c)


def keywords(scheme: str) -> Column:
    block = first(f'<keywords\\s+scheme="{scheme}">(.*?)</keywords>')
    return F.filter(F.transform(every(r"<term>(.*?)</term>", block), lambda t: unescape_xml(F.trim(t))), lambda t: t != "")


def split_key(key: Column, names: Column) -> Column:
    """(divinita, epiteti): as many first words as there are names, one at least, are the deity's."""
    words = F.filter(F.split(F.trim(key), r"\s+"), lambda w: w != "")
    n = F.greatest(names, F.lit(1))
    return F.struct(F.array_join(F.slice(words, F.lit(1), n), " ").alias("divinita"), F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))).alias("epiteti"))


def aliased(name: Column, aliases: dict[str, str] | None) -> Column:
    if not aliases:
        return name
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), name), name)


def deities(edition: Column, aliases: dict[str, str] | None = None) -> Column:
    """array<struct<divinita, epiteti>> of the divine persons, in order, not yet merged.

    A key is read only after the kind.  Without a key the names stand for themselves.
    """

    def one(block: Column) -> Column:
        attrs = F.regexp_extract(block, r'(?s)^<persName\s+[^>]*type="divine"([^>]*)>', 1)
        names = F.filter(F.transform(every(r"<name\b[^>]*>(.*?)</name>", block), plain), lambda x: x != "")
        keyed = split_key(attr(attrs, "key"), F.size(names))
        bare = F.struct(F.array_join(names, " ").alias("divinita"), F.array().cast("array<string>").alias("epiteti"))
        found = F.when(F.contains(attrs, F.lit('key="')), keyed).otherwise(bare)
        return F.struct(aliased(found["divinita"], aliases).alias("divinita"), found["epiteti"].alias("epiteti"))

    return F.filter(F.transform(every(r'<persName\s+[^>]*type="divine"[^>]*>.*?</persName>', edition, 0), one), lambda d: d["divinita"] != "")


def with_keywords(found: Column, terms: Column, aliases: dict[str, str] | None = None) -> Column:
    """found with the curated terms that it doesn't have as they stand: first word deity, the rest epithets."""
    new = F.filter(terms, lambda t: ~F.exists(found, lambda d: d["divinita"] == t))
    return F.concat(found, F.transform(new, lambda t: _aliased_pair(split_key(t, F.lit(1)), aliases)))


def _aliased_pair(pair: Column, aliases: dict[str, str] | None) -> Column:
    return F.struct(aliased(pair["divinita"], aliases).alias("divinita"), pair["epiteti"].alias("epiteti"))


def merged_pairs(found: Column) -> Column:
    """One entry per deity, in order of appearance, with all its epithets."""
    names = F.array_distinct(F.transform(found, lambda d: d["divinita"]))
    own = lambda n: F.array_distinct(F.flatten(F.transform(F.filter(found, lambda d: d["divinita"] == n), lambda d: d["epiteti"])))
    return F.transform(names, lambda n: F.struct(n.alias("divinita"), own(n).alias("epiteti")))


def persons(edition: Column, kind: str, *, or_text: bool = False) -> Column:
    """Keys of the persons of a kind, each once; or their text where there is no key."""

    def one(block: Column) -> Column:
        attrs = F.regexp_extract(block, f'(?s)^<persName\\s+[^>]*type="{kind}"([^>]*)>', 1)
        key = F.trim(attr(attrs, "key"))
        return F.when(F.contains(attrs, F.lit('key="')), key).otherwise(plain(block) if or_text else F.lit(""))

    return F.array_distinct(F.filter(F.transform(every(f'<persName\\s+[^>]*type="{kind}"[^>]*>.*?</persName>', edition, 0), one), lambda x: x != ""))


def listed_persons() -> Column:
    """array<struct> of the record's list of persons; what is missing is null."""

    def one(block: Column) -> Column:
        ethnic = F.regexp_extract(block, r'(?s)<placeName[^>]*type="ethnic"([^>]*)>(.*?)</placeName>', 1)
        name = F.regexp_extract(block, r"(?s)<name([^>]*)>(.*?)</name>", 1)
        return F.struct(
            F.trim(attr(block, "xml:id")).alias("xmlId"),
            filled(F.trim(unescape_xml(F.regexp_extract(block, r'<persName[^>]*key="([^"]*)"', 1)))).alias("key"),
            filled(F.trim(attr(name, "nymRef"))).alias("nymRef"),
            F.coalesce(filled(plain(F.regexp_extract(block, r"(?s)<name[^>]*>(.*?)</name>", 1)), plain(F.regexp_extract(block, r"(?s)<persName[^>]*>(.*?)</persName>", 1))), F.lit("")).alias("name"),
            filled(F.trim(F.regexp_extract(ethnic, r'\bref="([^"]*)"', 1))).alias("ethnicRef"),
            filled(F.trim(attr(ethnic, "nymRef"))).alias("ethnicNymRef"),
            filled(plain(F.regexp_extract(block, r'(?s)<placeName[^>]*type="ethnic"[^>]*>(.*?)</placeName>', 1))).alias("ethnicText"),
            filled(plain(F.regexp_extract(block, r"(?s)<note>(.*?)</note>", 1))).alias("note"),
        )

    return F.transform(every(r'<person\s+[^>]*xml:id="[^"]*"[^>]*>.*?</person>', first(r"<listPerson>(.*?)</listPerson>"), 0), one)


def dates() -> Column:
    """array<struct> of the dates of origin; custom calendars come before plain ones, a single year is both bounds."""
    origin = F.regexp_replace(first(r"<origin>(.*?)</origin>"), r"(?s)<origPlace>.*?</origPlace>", "")

    def one(piece: Column) -> Column:
        attrs = F.regexp_extract(piece, r"(?s)<origDate([^>]*)>", 1)
        low, high = filled(attr(attrs, "notBefore-custom"), attr(attrs, "notBefore")), filled(attr(attrs, "notAfter-custom"), attr(attrs, "notAfter"))
        single = F.coalesce(low, filled(attr(attrs, "when")))
        before = F.regexp_replace(F.regexp_extract(piece, r"(?s)^(.*?)<origDate", 1), "<[^>]+>", "")
        return F.struct(
            filled(F.regexp_replace(before, r"^[\s,;]+|[\s,;]+$", "")).alias("prefix"),
            filled(attr(attrs, "datingMethod")).alias("datingMethod"),
            F.coalesce(low, single).alias("notBeforeCustom"),
            F.coalesce(high, single).alias("notAfterCustom"),
            filled(attr(attrs, "precision")).alias("precision"),
            filled(attr(attrs, "evidence")).alias("evidence"),
            unescape_xml(F.trim(F.regexp_extract(piece, r"(?s)<origDate[^>]*>(.*?)</origDate>", 1))).alias("testo"),
        )

    return F.transform(every(r".*?<origDate[^>]*>.*?</origDate>", origin, 0), one)


def bound(found: Column, field: str) -> Column:
    """The first date whose bound is a number; the two bounds may come from different dates."""
    return F.get(F.filter(F.transform(found, lambda d: d[field].try_cast("double").cast("int")), lambda y: y.isNotNull()), F.lit(0))


def apparatus() -> tuple[Column, Column]:
    """(entries, text): notes or readings by place, or the text where there is no entry."""
    block = first(r'<div type="apparatus"[^>/]*>(.*?)</div>')
    usable = F.when(F.contains(block, F.lit("<div")), F.lit("")).otherwise(block)

    def one(app: Column) -> Column:
        inner = F.regexp_extract(app, r"(?s)^<app[^>]*>(.*)</app>$", 1)
        lemma = resolved(F.regexp_extract(inner, r"(?s)<lem[^>]*>(.*?)</lem>", 1))
        readings = F.filter(F.transform(every(r"<rdg[^>]*>(.*?)</rdg>", inner), resolved), lambda r: r != "")
        variants = filled(F.concat_ws(" | ", F.concat(F.filter(F.array(lemma), lambda x: x != ""), readings)))
        note = F.coalesce(filled(resolved(F.regexp_extract(inner, r"(?s)<note[^>]*>(.*?)</note>", 1))), variants, resolved(inner))
        return F.struct(F.trim(attr(app, "loc")).alias("loc"), note.alias("note"))

    entries = F.filter(F.transform(every(r'<app\s+[^>]*loc="[^"]*"[^>]*>.*?</app>', usable, 0), one), lambda e: e["note"] != "")
    text = plain(usable)
    return entries, F.when((F.size(entries) > 0) | is_placeholder(text), F.lit("")).otherwise(text)


def translations() -> Column:
    real = lambda c: F.when(is_placeholder(c), F.lit("")).otherwise(c)

    def one(block: Column) -> Column:
        inner = F.regexp_extract(block, r"(?s)^<div[^>]*>(.*)</div>$", 1)
        paragraphs = F.array_join(F.transform(every(r"<p>(.*?)</p>", inner), lambda p: unescape_xml(F.trim(p))), "\n")
        return F.struct(
            attr(block, "xml:lang").alias("lang"),
            real(F.coalesce(filled(paragraphs), unescape_xml(F.trim(inner)))).alias("testo"),
            real(unescape_xml(F.trim(F.regexp_extract(inner, r"(?s)<note>(.*?)</note>", 1)))).alias("note"),
        )

    return F.transform(every(r'<div type="translation" xml:lang="[^"]+"[^>/]*>.*?</div>', "tei", 0), one)


def bibliography() -> Column:
    """array<struct>: one entry of prose where more than three characters stand outside its entries, else one each."""
    block = first(r'<div type="bibliography"[^>/]*>(.*?)</div>')
    outside = plain(F.regexp_replace(F.regexp_replace(block, r"(?s)<bibl>.*?</bibl>", ""), r"(?s)<head>.*?</head>", ""))
    prose = F.coalesce(filled(first(r"<p>(.*?)</p>", block)), block)
    raw = F.when(F.length(outside) > 3, F.array(prose)).otherwise(F.transform(every(r"<bibl>(.*?)</bibl>", block), F.trim))
    cited = lambda x: F.transform(every(r"<citedRange[^>]*>(.*?)</citedRange>", x), plain)
    return F.filter(F.transform(raw, lambda x: F.struct(resolved(x).alias("titolo"), cited(x).alias("citedRanges"), x.alias("rawXml"))), lambda b: b["titolo"] != "")


def iconography() -> Column:
    """struct<function, figures, note>, or null; figures and traits need a type and a key."""
    block = first(r"<xenoData>.*?<iconography[^>]*>(.*?)</iconography>.*?</xenoData>")
    own = lambda c, name: F.regexp_extract(c, f'(?:^|\\s){name}="([^"]*)"', 1)

    def trait(attrs: Column) -> Column:
        return F.struct(own(attrs, "type").alias("type"), own(attrs, "key").alias("key"), filled(own(attrs, "hand")).alias("hand"))

    def figure(piece: Column) -> Column:
        attrs = F.regexp_extract(piece, r"(?s)^<figure([^>]*?)/?>", 1)
        traits = F.filter(F.transform(every(r"<trait([^>]*)>", piece), trait), lambda t: (t["type"] != "") & (t["key"] != ""))
        n = F.coalesce(own(attrs, "n").try_cast("int"), F.lit(1))
        return F.struct(n.alias("n"), own(attrs, "type").alias("type"), own(attrs, "key").alias("key"), filled(own(attrs, "place")).alias("place"), traits.alias("traits"))

    figures = F.filter(F.transform(every(r"<figure[^>]*?(?:/>|>.*?</figure>)", block, 0), figure), lambda f: (f["type"] != "") & (f["key"] != ""))
    function = filled(F.regexp_extract(block, r'<function[^>]*key="([^"]*)"', 1), F.regexp_extract(block, r'<support[^>]*key="([^"]*)"', 1))
    return F.when(block != "", F.struct(function.alias("function"), figures.alias("figures"), filled(first(r"<note[^>]*>(.*?)</note>", block)).alias("note")))


def kinds() -> Column:
    return F.transform(every(r'<rs\s+type="textType"[^>]*>(.*?)</rs>'), plain)


def mentions(terms: Column, words: tuple[str, ...]) -> Column:
    """Whether a term contains one of the words; so what says that there is no inscription also mentions one."""
    return F.exists(terms, lambda t: F.lower(t).rlike("|".join(words)))


def extract(records: DataFrame, *, keep: tuple[str, ...] = (), aliases: dict[str, str] | None = None, catalogue: str | None = None) -> DataFrame:
    """The fields of every record (column tei).

    aliases: deities known under another name; catalogue: a pattern of catalogue references to take out of titles.
    """
    edition = first(r'<div\s+type="edition"[^>]*>(.*?)' + AFTER_EDITION)
    title = F.regexp_replace(first(r"<titleStmt>.*?<title[^>]*>(.*?)</title>"), r'(?s)<rs\s+[^>]*type="textType"[^>]*>.*?</rs>', "")
    title = F.regexp_replace(title, catalogue, "") if catalogue else title
    title = F.regexp_replace(F.regexp_replace(unescape_xml(title), "<[^>]+>", " "), r"^[\s—:-]+|[\s—:-]+$", "")
    width, least, most = opening("width"), attr(opening("width"), "atLeast"), attr(opening("width"), "atMost")
    place = lambda kind: unescape_xml(first(f'<placeName\\s+type="{kind}"[^>]*>(.*?)</placeName>'))
    place_ref = lambda kind: F.regexp_extract(first(f'<placeName\\s+type="{kind}"([^>]*)>'), 'ref="([^"]*)"', 1)
    entries, text = apparatus()
    graphic = first(r'<graphic\s+url="[^"]*"[^>]*>(.*?)</graphic>')
    # What several fields are made of is read once, below them.
    read = records.select(
        *keep,
        "tei",
        edition.alias("edition"),
        kinds().alias("kinds"),
        dates().alias("origDates"),
        keywords("epiteti").alias("kw_epiteti"),
        element("height").alias("dim_altezza"),
        F.when((least != "") & (most != ""), F.concat_ws("-", least, most)).when(least != "", F.concat(least, F.lit("-"))).otherwise(element("width")).alias("dim_larghezza"),
        element("depth").alias("dim_profondita"),
        F.coalesce(filled(attr(opening("depth"), "unit"), attr(width, "unit"), attr(opening("height"), "unit")), F.lit("metre")).alias("dim_unita"),
        resolved(first(r"<supportDesc>.*?<support[^>]*>.*?<p>(.*?)</p>")).alias("support"),
    )
    read = read.withColumn("pairs", with_keywords(deities(F.col("edition"), aliases), keywords("divinita"), aliases))
    return read.select(
        *keep,
        F.coalesce(F.regexp_extract("tei", r'<idno\s+type="id">(\d+)</idno>', 1).try_cast("long"), F.lit(0).cast("long")).alias("id"),
        filled(*(unescape_xml(first(f'<idno\\s+type="{k}">(.*?)</idno>')) for k in ("entryId", "firebaseId"))).alias("entryId"),
        unescape_xml(first(r'<idno\s+type="TM"[^>]*>(.*?)</idno>')).alias("tm"),
        F.regexp_extract(first(r'<idno\s+type="TM"([^>]*)>'), 'ref="([^"]*)"', 1).alias("tmLink"),
        F.transform(every(r'<idno\s+type="PHI">(.*?)</idno>'), lambda x: unescape_xml(F.trim(x))).alias("phi"),
        element("authority").alias("authority"),
        F.transform(every(r"<change\s+[^>]*>.*?</change>", first(r"<revisionDesc>(.*?)</revisionDesc>"), 0), lambda x: F.struct(attr(x, "when").alias("date"), attr(x, "who").alias("who"), filled(plain(x)).alias("note"))).alias("revisions"),
        spaced(title).alias("titolo"),
        element("repository").alias("luogo_cons"),
        F.transform(every(r"<idno[^>]*>(.*?)</idno>", first(r"<msIdentifier>(.*?)</msIdentifier>")), lambda x: unescape_xml(F.trim(x))).alias("msIdnos"),
        element("material").alias("materiale"),
        F.regexp_extract(opening("material"), 'ref="([^"]*)"', 1).alias("materialRef"),
        element("objectType").alias("tipo"),
        F.regexp_extract(opening("objectType"), 'ref="([^"]*)"', 1).alias("tipo_ref"),
        "dim_altezza",
        "dim_larghezza",
        "dim_profondita",
        "dim_unita",
        F.coalesce(filled(F.col("support")), composed_dimensions()).alias("dim"),
        resolved(first(r"<layoutDesc>.*?<layout[^>]*>.*?<p>(.*?)</p>")).alias("layout_desc"),
        unescape_xml(first(r"<layoutDesc>.*?<layout[^>]*>.*?<rs[^>]*>(.*?)</rs>")).alias("scrittura"),
        F.regexp_extract(first(r"<layoutDesc>.*?<layout[^>]*>.*?<rs([^>]*)>"), 'ref="([^"]*)"', 1).alias("scrittura_ref"),
        paragraph(first(r"<handDesc>.*?<handNote[^>]*>(.*?)</handNote>")).alias("scrittura_note"),
        place("ancient").alias("citta"),
        place_ref("ancient").alias("place_ref_ancient"),
        place("modern").alias("luogo_moderno"),
        place_ref("modern").alias("place_ref_modern"),
        F.coalesce(filled(place("region"), unescape_xml(first(r'<geogName\s+[^>]*type="ancientRegion"[^>]*>(.*?)</geogName>'))), F.lit("")).alias("regione"),
        F.regexp_replace(plain(F.regexp_replace(first(r"<origPlace>(.*?)</origPlace>"), r"(?s)<placeName[^>]*>.*?</placeName>", "")), r"^[\s;]+|[\s;]+$", "").alias("origPlace_nota"),
        "origDates",
        F.array_join(F.transform("origDates", lambda d: F.concat_ws(" ", d["prefix"], d["testo"])), " / ").alias("data"),
        bound(F.col("origDates"), "notBeforeCustom").alias("data_inizio"),
        bound(F.col("origDates"), "notAfterCustom").alias("data_fine"),
        paragraph(first(r'<provenance\s+type="found"[^>]*>(.*?)</provenance>')).alias("luogo_rit"),
        paragraph(first(r'<provenance\s+type="observed"[^>]*>(.*?)</provenance>')).alias("conserv"),
        F.array_distinct(F.filter("kinds", lambda t: (t != "") & (F.lower(t) != GENERIC))).alias("textTypes"),
        mentions(F.col("kinds"), WRITTEN).alias("iscrizione"),
        mentions(F.col("kinds"), UNWRITTEN).alias("anepigr"),
        unescape_xml(first(r'<graphic\s+url="([^"]*)"')).alias("facsimile_url"),
        unescape_xml(first(r"<desc>(.*?)</desc>", graphic)).alias("facsimile_desc"),
        unescape_xml(F.col("edition")).alias("testo"),
        F.array_distinct(F.transform("pairs", lambda d: d["divinita"])).alias("divinita"),
        F.array_distinct(F.concat("kw_epiteti", F.flatten(F.transform("pairs", lambda d: d["epiteti"])))).alias("epiteti"),
        merged_pairs(F.col("pairs")).alias("divinitaEpiteti"),
        F.array_union(persons(F.col("edition"), "attested", or_text=True), keywords("onomastica")).alias("onomastica"),
        persons(F.col("edition"), "emperor").alias("imperatori"),
        listed_persons().alias("persone"),
        entries.alias("apparatus_entries"),
        text.alias("apparatus_text"),
        translations().alias("traduzioni"),
        paragraph(first(r'<div type="commentary"[^>/]*>(.*?)</div>')).alias("note_interne"),
        bibliography().alias("bibliografia"),
        iconography().alias("iconografia"),
    )


def with_searchable(records: DataFrame) -> DataFrame:
    """Adds the running text of the edition and its supplied ranges."""
    found = records.withColumn("__t", F.udf(linearise, LINEARISED, useArrow=True)(F.col("testo")))
    return found.withColumn("testo_searchable", F.col("__t.text")).withColumn("supplied_ranges", F.col("__t.ranges")).drop("__t")


def render_iconography(ico: Column) -> Column:
    """The block of a record's iconography, figures numbered by place; null where there is nothing to say."""
    attribute = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), escape_xml(c), F.lit('"')), F.lit(""))
    trait = lambda t: F.concat(F.lit("<trait"), attribute("type", t["type"]), attribute("key", t["key"]), attribute("hand", t["hand"]), F.lit("/>"))

    def figure(f: Column, i: Column) -> Column:
        head = F.concat(F.lit("<figure"), attribute("n", (i + 1).cast("string")), attribute("type", f["type"]), attribute("key", f["key"]), attribute("place", f["place"]))
        inner = F.array_join(F.transform(F.filter(f["traits"], lambda t: (t["type"] != "") & (t["key"] != "")), trait), "")
        return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit("</figure>")))

    body = F.concat(
        F.coalesce(F.concat(F.lit("<function"), attribute("key", ico["function"]), F.lit("/>")), F.lit("")),
        F.array_join(F.transform(ico["figures"], figure), ""),
        F.coalesce(F.concat(F.lit("<note>"), escape_xml(ico["note"]), F.lit("</note>")), F.lit("")),
    )
    some = ico["function"].isNotNull() | (F.size(ico["figures"]) > 0) | ico["note"].isNotNull()
    return F.when(some, F.concat(F.lit("<xenoData><iconography>"), body, F.lit("</iconography></xenoData>")))


def _attribute(name: str, value: Column) -> Column:
    """`` name="value"``, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def _joined(items: Column, one) -> Column:
    """one(item) of every item of a list, one after another; nothing for a null list."""
    return F.coalesce(F.array_join(F.transform(items, one), ""), F.lit(""))


def _wrapped(name: str, *inner: Column | str, attrs: Column | str = "") -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.concat(F.lit(f"<{name}"), lit(attrs), F.lit(">"), *map(lit, inner), F.lit(f"</{name}>"))


def _terms(scheme: str, items: Column) -> Column:
    return _wrapped("keywords", _joined(items, lambda t: _wrapped("term", escape_xml(t))), attrs=f' scheme="{scheme}"')


def _deity_terms(pairs: Column) -> Column:
    """Curated terms that say the pairs again; a name of several words can't take its epithets along."""
    bare = lambda p: (F.size(p["epiteti"]) == 0) | F.contains(p["divinita"], F.lit(" "))
    return F.transform(pairs, lambda p: F.when(bare(p), p["divinita"]).otherwise(F.concat_ws(" ", p["divinita"], F.array_join(p["epiteti"], " "))))


def _written_kinds(has: set[str]) -> Column:
    """The kinds of text; that there is an inscription is said by the kind that says nothing else."""
    listed = F.coalesce("textTypes", F.array().cast("array<string>")) if "textTypes" in has else F.array().cast("array<string>")
    if "iscrizione" not in has:
        return listed
    return F.when(F.coalesce("iscrizione", F.lit(False)) & ~mentions(listed, WRITTEN), F.concat(listed, F.array(F.lit(GENERIC)))).otherwise(listed)


def _written_date(d: Column) -> Column:
    names = {"datingMethod": "datingMethod", "notBefore-custom": "notBeforeCustom", "notAfter-custom": "notAfterCustom", "precision": "precision", "evidence": "evidence"}
    attrs = F.concat(*(_attribute(name, escape_xml(d[field])) for name, field in names.items()))
    return F.concat(F.lit("; "), F.coalesce(d["prefix"], F.lit("")), F.lit(" "), _wrapped("origDate", escape_xml(F.coalesce(d["testo"], F.lit(""))), attrs=attrs))


def _written_person(p: Column) -> Column:
    ethnic = p["ethnicRef"].isNotNull() | p["ethnicNymRef"].isNotNull() | p["ethnicText"].isNotNull()
    name = _wrapped("name", escape_xml(F.coalesce(p["name"], F.lit(""))), attrs=_attribute("nymRef", escape_xml(p["nymRef"])))
    place = F.concat(F.lit(' type="ethnic"'), _attribute("ref", p["ethnicRef"]), _attribute("nymRef", escape_xml(p["ethnicNymRef"])))
    return _wrapped(
        "person",
        _wrapped("persName", name, attrs=_attribute("key", escape_xml(p["key"]))),
        F.when(ethnic, _wrapped("placeName", escape_xml(F.coalesce(p["ethnicText"], F.lit(""))), attrs=place)).otherwise(""),
        F.coalesce(_wrapped("note", escape_xml(p["note"])), F.lit("")),
        attrs=_attribute("xml:id", escape_xml(p["xmlId"])),
    )


def _written_translation(t: Column) -> Column:
    """A paragraph a line; what is empty is said by the placeholder."""
    lines = _joined(F.split(t["testo"], "\n"), lambda x: _wrapped("p", escape_xml(x)))
    text = F.when(F.coalesce(t["testo"], F.lit("")) == "", F.lit("<p>DA_COMPILARE</p>")).otherwise(lines)
    note = F.when(F.coalesce(t["note"], F.lit("")) != "", _wrapped("note", escape_xml(t["note"]))).otherwise("")
    return _wrapped("div", text, note, attrs=F.concat(F.lit(' type="translation"'), _attribute("xml:lang", escape_xml(t["lang"]))))


def _written_bibliography(entries: Column) -> Column:
    """Entries as they were read; prose that holds entries of its own is one paragraph again."""
    return _joined(entries, lambda b: F.when(F.contains(b["rawXml"], F.lit("<bibl>")), _wrapped("p", b["rawXml"])).otherwise(_wrapped("bibl", b["rawXml"])))


def composed_dimensions() -> Column:
    return F.trim(F.concat_ws(" ", F.concat_ws(" x ", "dim_altezza", "dim_larghezza", "dim_profondita"), "dim_unita"))


def to_xml(records: DataFrame) -> DataFrame:
    """(id, tei): the fields that extract reads and records has, as one XML record each.

    What is read as it stands (references, bibliography, prefixes of dates, the edition) is written so, everything
    else is escaped.  Lost are which paragraphs and inline tags prose had, and epithets that only a curated term
    gives to a deity whose name has several words.
    """
    has = set(records.columns)
    no = F.lit("")
    said = lambda c: escape_xml(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in has else no
    ref = lambda c: _attribute("ref", F.nullif(c, F.lit(""))) if c in has else no
    tag = lambda name, c, attrs="": _wrapped(name, said(c), attrs=attrs) if c in has else no
    each = lambda c, one: _joined(F.col(c), one) if c in has else no
    within = lambda name, *inner, attrs="", of=(): _wrapped(name, *inner, attrs=attrs) if has.intersection(of) else no
    prose = lambda c: _wrapped("p", said(c))
    placed = lambda kind, c, to: _wrapped("placeName", said(c), attrs=F.concat(F.lit(f' type="{kind}"'), ref(to))) if c in has else no
    change = lambda r: _wrapped("change", escape_xml(F.coalesce(r["note"], F.lit(""))), attrs=F.concat(_attribute("when", escape_xml(r["date"])), _attribute("who", escape_xml(r["who"]))))
    number = lambda kind, c: _wrapped("idno", said(c), attrs=F.concat(F.lit(f' type="{kind}"'), ref(f"{c}Link"))) if c in has else no
    unit = _attribute("unit", said("dim_unita")) if "dim_unita" in has else no
    measured = all(c in has for c in ("dim_altezza", "dim_larghezza", "dim_profondita", "dim_unita"))
    support = no
    if "dim" in has:
        support = _wrapped("supportDesc", _wrapped("support", prose("dim")))
        support = F.when(F.coalesce(F.col("dim") == composed_dimensions(), F.lit(False)), no).otherwise(support) if measured else support
    if "origDates" in has:
        dated = _joined(F.col("origDates"), _written_date)
    else:
        year = lambda a, c: _attribute(f"{a}-custom", F.col(c).cast("string")) if c in has else no
        dated = _wrapped("origDate", attrs=F.concat(year("notBefore", "data_inizio"), year("notAfter", "data_fine")))
    deities_said = _deity_terms(F.col("divinitaEpiteti")) if "divinitaEpiteti" in has else F.col("divinita") if "divinita" in has else None
    app = lambda e: _wrapped("app", _wrapped("note", escape_xml(e["note"])), attrs=_attribute("loc", escape_xml(e["loc"])))
    open_end = F.size(F.regexp_extract_all(F.col("testo"), F.lit(r"(<div\b)"), F.lit(1))) < F.size(F.regexp_extract_all(F.col("testo"), F.lit("(</div>)"), F.lit(1))) if "testo" in has else F.lit(False)
    parts = [
        F.lit("<TEI>"), within("titleStmt", tag("title", "titolo"), of=("titolo",)), tag("authority", "authority"),
        tag("idno", "id", ' type="id"'), tag("idno", "entryId", ' type="entryId"'), number("TM", "tm"), each("phi", lambda x: _wrapped("idno", escape_xml(x), attrs=' type="PHI"')),
        within("msIdentifier", tag("repository", "luogo_cons"), each("msIdnos", lambda x: _wrapped("idno", escape_xml(x))), of=("luogo_cons", "msIdnos")),
        _wrapped("material", said("materiale"), attrs=ref("materialRef")), _wrapped("objectType", said("tipo"), attrs=ref("tipo_ref")), support,
        within("dimensions", *(_wrapped(name, said(c), attrs=unit) for name, c in (("height", "dim_altezza"), ("width", "dim_larghezza"), ("depth", "dim_profondita"))), of=("dim_altezza", "dim_larghezza", "dim_profondita", "dim_unita")),
        within("layoutDesc", _wrapped("layout", _wrapped("rs", said("scrittura"), attrs=F.concat(F.lit(' type="execution"'), ref("scrittura_ref"))), prose("layout_desc")), of=("scrittura", "layout_desc")),
        within("handDesc", _wrapped("handNote", prose("scrittura_note")), of=("scrittura_note",)),
        _wrapped("origin", _wrapped("origPlace", said("origPlace_nota"), placed("ancient", "citta", "place_ref_ancient"), placed("modern", "luogo_moderno", "place_ref_modern"), tag("placeName", "regione", ' type="region"')), dated),
        within("provenance", prose("luogo_rit"), attrs=' type="found"', of=("luogo_rit",)), within("provenance", prose("conserv"), attrs=' type="observed"', of=("conserv",)),
        _joined(_written_kinds(has), lambda t: _wrapped("rs", escape_xml(t), attrs=' type="textType"')),
        within("graphic", tag("desc", "facsimile_desc"), attrs=_attribute("url", said("facsimile_url")), of=("facsimile_url", "facsimile_desc")),
        within("revisionDesc", each("revisions", change), of=("revisions",)), within("listPerson", each("persone", _written_person), of=("persone",)),
    ]
    parts += [_terms(c, F.col(c)) for c in ("epiteti", "onomastica") if c in has]
    if deities_said is not None:
        parts.append(_terms("divinita", deities_said))
    if "iconografia" in has:
        parts.append(F.coalesce(render_iconography(F.col("iconografia")), no))
    if "testo" in has:
        parts += [F.lit('<body><div type="edition">'), F.coalesce("testo", no), F.when(open_end, no).otherwise("</div>")]
    else:
        parts.append(F.lit("<body>"))
    parts += [
        within("div", each("apparatus_entries", app), _wrapped("p", said("apparatus_text")), attrs=' type="apparatus"', of=("apparatus_entries", "apparatus_text")), each("traduzioni", _written_translation),
        within("div", prose("note_interne"), attrs=' type="commentary"', of=("note_interne",)), within("div", _written_bibliography(F.col("bibliografia")) if "bibliografia" in has else no, attrs=' type="bibliography"', of=("bibliografia",)),
    ]
    return records.select("id", F.concat(*parts, F.lit("</body></TEI>")).alias("tei"))


def differs_in_writing(records: DataFrame) -> DataFrame:
    """Records whose unit of measure would be written as the default although it was given on the whole block."""
    return records.where(F.col("tei").rlike(r"<dimensions[^>]*unit=") & ~F.col("tei").rlike(r"<(?:height|width|depth)[^>]*unit="))
