"""Queries of every field of a record, of labels, running text, suggestions from editions, and the catalogue's smaller filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.markup import leiden
from corpusloom.operators import catalogue, derive, markup, mutate, records as xml, rules, search, statistics, timeline
from corpusloom.plans.texts import _index
from corpusloom.plans.views import RECORDS, dealt, records, table

Q: dict[str, str] = {}

#: A record's text in pieces: plain ones, names of columns in braces, and (modulus, remainder, piece, other piece).
_RECORD: list = [
    "<TEI><teiHeader><titleStmt><title>{w1} &amp; {w2} ", (2, 1, '<rs type="textType">x</rs>', ""), ' —</title></titleStmt><idno type="id">{k}</idno>', (3, 0, '<idno type="entryId">e{k}</idno>', '<idno type="firebaseId">f{k}</idno>'),
    '<idno type="TM" ref="http://tm/{k}">t{s}</idno>', (4, 1, '<idno type="PHI"> p{k} </idno><idno type="PHI">q</idno>', ""), "<authority>{t}</authority><msIdentifier><repository>{b}</repository><idno>inv {s}</idno></msIdentifier><supportDesc><support>",
    (5, 2, '<p>A  {w1} <ptr target="#b{k}"/>, <expan><abbr>ab</abbr><ex>cd</ex></expan></p>', ""), '<material ref="m{s}">{w2}</material><objectType ref="o">{t}</objectType></support></supportDesc><height unit="cm">{s}</height>',
    (3, 0, '<width atLeast="1" atMost="2">x</width>', ""), (3, 1, '<width atLeast="3">x</width>', ""), (3, 2, "<width>4</width>", ""),
    '<depth>{s}</depth><layoutDesc><layout><rs type="execution" ref="r{k}">{w1}</rs><p>lines <foreign xml:lang="grc">λ{k}</foreign></p></layout></layoutDesc><handDesc><handNote><p>tall {w1}</p></handNote></handDesc>',
    '<origin><origPlace>near <placeName type="ancient" ref="a{k}">{w1} town</placeName>; <placeName type="modern" ref="z">{w2} ville</placeName></origPlace> about <origDate notBefore-custom="-{k}" notAfter-custom="{s}" evidence="letters" precision="low">c. {s}</origDate>',
    (2, 0, ', or <origDate when="70">in 70</origDate>', ""), "</origin>", (3, 1, '<placeName type="region">{b}</placeName>', '<geogName type="ancientRegion">{t}</geogName>'),
    '<provenance type="found"><p>in {w1}</p></provenance><provenance type="observed">lost</provenance><rs type="textType">', (4, 0, "Dedica", ""), (4, 1, "Senza iscrizione", ""), (4, 2, "Decreto", ""), (4, 3, "Iscrizione greca", ""),
    '</rs><keywords scheme="epiteti"><term>Soter</term><term>{w1}</term></keywords><keywords scheme="divinita"><term>Zeus</term></keywords><keywords scheme="onomastica"><term>{w2}</term></keywords>',
    '<revisionDesc><change when="2020-01" who="#me">made {k}</change></revisionDesc><listPerson><person xml:id="p{k}"><persName key="{w1}"><name nymRef="n{k}">{w2}</name></persName><placeName type="ethnic" ref="e{k}">of {t}</placeName><note>kin</note></person></listPerson>',
    '<xenoData><iconography><function key="{t}"/><figure n="1" type="god" key="{w1}" place="top"><trait type="held" key="{w2}" hand="left"/><trait type="x"/></figure><figure key="z"/><note>faint</note></iconography></xenoData><graphic url="u{k}"><desc>d{s}</desc></graphic></teiHeader>',
    '<text><body><div type="edition"><ab><lb n="1"/><persName type="divine" key="Men {w1}"><name>x</name></persName> <persName type="attested" key="{w2}">d</persName><persName type="emperor" key="K{s}">k</persName></ab></div><div type="apparatus">',
    (2, 0, '<app loc="1"><note>n{k}</note></app><app loc="2"><lem>l</lem><rdg>r1</rdg><rdg>r2</rdg></app>', "free {w1}"), '</div><div type="translation" xml:lang="it"><p>uno {w1}</p><p>due</p><note>', (3, 0, "DA_COMPILARE", "nota"),
    '</note></div><div type="commentary"><p>com {w2}</p></div><div type="bibliography"><bibl>{w1} 1990 <citedRange>p. {k}</citedRange></bibl></div></body></text></TEI>',
]
_COLUMNS = {"k": "p_partkey", "s": "p_size", "t": "p_type", "b": "p_brand"}


def _filled(piece: str) -> Column:
    parts = []
    for i, x in enumerate(piece.replace("}", "{").split("{")):
        word = {"w1": F.split_part("p_name", F.lit(" "), F.lit(1)), "w2": F.split_part("p_name", F.lit(" "), F.lit(2))}
        parts.append(F.lit(x) if i % 2 == 0 else word[x] if x in word else F.col(_COLUMNS[x]).cast("string"))
    return F.concat(*parts)


def _composed(pieces: list) -> Column:
    return F.concat(*(_filled(p) if isinstance(p, str) else F.when(F.col("p_partkey") % p[0] == p[1], _filled(p[2])).otherwise(_filled(p[3])) for p in pieces))


def record_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field that is read of records put together from parts, a row each, lists and structures in one text."""
    files = dealt(spark, d, "part", "p_partkey").select(_composed(_RECORD).alias("xml"))
    found = xml.extract(xml.split_records(files))
    some = lambda *c: F.concat_ws("/", *(F.coalesce(x.cast("string"), F.lit("-")) for x in c))
    each = lambda c, f: F.array_join(F.transform(c, f), "; ")
    shown = {
        "revisions": each("revisions", lambda r: some(r["date"], r["who"], r["note"])), "phi": F.array_join("phi", "; "), "msIdnos": F.array_join("msIdnos", "; "), "textTypes": F.array_join("textTypes", "; "),
        "origDates": each("origDates", lambda o: some(o["prefix"], o["datingMethod"], o["notBeforeCustom"], o["notAfterCustom"], o["precision"], o["evidence"], o["testo"])),
        "divinitaEpiteti": each("divinitaEpiteti", lambda x: some(x["divinita"], F.array_join(x["epiteti"], ","))),
        "persone": each("persone", lambda p: some(*(p[f] for f in ("xmlId", "key", "nymRef", "name", "ethnicRef", "ethnicNymRef", "ethnicText", "note")))),
        "apparatus_entries": each("apparatus_entries", lambda a: some(a["loc"], a["note"])), "traduzioni": each("traduzioni", lambda t: some(t["lang"], t["testo"], t["note"])),
        "bibliografia": each("bibliografia", lambda b: some(b["titolo"], F.array_join(b["citedRanges"], ","), b["rawXml"])),
        "iconografia": F.concat_ws(" | ", "iconografia.function", each("iconografia.figures", lambda f: some(f["n"], f["type"], f["key"], f["place"], F.array_join(F.transform(f["traits"], lambda t: some(t["type"], t["key"], t["hand"])), ","))), "iconografia.note"),
        **{f: F.array_join(f, "; ") for f in ("divinita", "epiteti", "onomastica", "imperatori")},
    }
    fields = F.array(*(F.struct(F.lit(c).alias("field"), (shown[c] if c in shown else F.col(c).cast("string")).alias("value")) for c in found.columns if c != "id"))
    return found.select("id", F.explode(fields).alias("x")).select("id", "x.field", "x.value")


def _sql(piece: str) -> str:
    """A text with names in braces as an SQL expression."""
    parts = [f"'{x}'" if i % 2 == 0 else f"CAST({x} AS VARCHAR)" for i, x in enumerate(piece.replace("}", "{").split("{")) if x or i % 2]
    return " || ".join(parts) or "''"


def _case(m: int, *pieces: str) -> str:
    return "CASE " + " ".join(f"WHEN k % {m} = {i} THEN {_sql(p)}" for i, p in enumerate(pieces)) + " END"


_WIDTH = _case(3, "1-2", "3-", "4")
_EDITION = '<ab><lb n="1"/><persName type="divine" key="Men {w1}"><name>x</name></persName> <persName type="attested" key="{w2}">d</persName><persName type="emperor" key="K{s}">k</persName></ab></div>'
_EXPECTED = {
    "entryId": _case(3, "e{k}", "f{k}", "f{k}"), "tm": _sql("t{s}"), "tmLink": _sql("http://tm/{k}"), "phi": _case(4, "", "p{k}; q", "", ""), "authority": "t", "revisions": _sql("2020-01/#me/made {k}"), "titolo": _sql("{w1} & {w2}"), "luogo_cons": "b",
    "msIdnos": _sql("inv {s}"), "materiale": "w2", "materialRef": _sql("m{s}"), "tipo": "t", "tipo_ref": "'o'", "dim_altezza": _sql("{s}"), "dim_larghezza": _WIDTH, "dim_profondita": _sql("{s}"), "dim_unita": "'cm'",
    "dim": f"CASE WHEN k % 5 = 2 THEN {_sql('A {w1} b{k}, ab(cd)')} ELSE {_sql('lines «λ{k}»')} END",  # the first paragraph after the support opens, wherever it stands
    "layout_desc": _sql("lines «λ{k}»"), "scrittura": "w1", "scrittura_ref": _sql("r{k}"), "scrittura_note": _sql("tall {w1}"),
    "citta": _sql("{w1} town"), "place_ref_ancient": _sql("a{k}"), "luogo_moderno": _sql("{w2} ville"), "place_ref_modern": "'z'", "regione": "CASE WHEN k % 3 = 1 THEN b ELSE t END", "origPlace_nota": "'near'",
    "origDates": _case(2, "about/-/-{k}/{s}/low/letters/c. {s}; or/-/70/70/-/-/in 70", "about/-/-{k}/{s}/low/letters/c. {s}"), "data": _case(2, "about c. {s} / or in 70", "about c. {s}"), "data_inizio": "CAST(-k AS VARCHAR)", "data_fine": _sql("{s}"),
    "luogo_rit": _sql("in {w1}"), "conserv": "'lost'", "textTypes": _case(4, "Dedica", "x; Senza iscrizione", "Decreto", "x"), "iscrizione": "CAST(k % 4 > 0 AS VARCHAR)", "anepigr": "CAST(k % 4 = 1 AS VARCHAR)", "facsimile_url": _sql("u{k}"), "facsimile_desc": _sql("d{s}"),
    "testo": _sql(_EDITION), "divinita": "'Men; Zeus'", "epiteti": _sql("Soter; {w1}"), "divinitaEpiteti": _sql("Men/{w1}; Zeus/"), "onomastica": "w2", "imperatori": _sql("K{s}"), "persone": _sql("p{k}/{w1}/n{k}/{w2}/e{k}/-/of {t}/kin"),
    "apparatus_entries": _case(2, "1/n{k}; 2/l | r1 | r2", ""), "apparatus_text": _case(2, "", "free {w1}"), "traduzioni": f"{_sql('it/uno {w1}')} || chr(10) || 'due/' || CASE WHEN k % 3 = 0 THEN '' ELSE 'nota' END", "note_interne": _sql("com {w2}"),
    "bibliografia": _sql("{w1} 1990 p. {k}/p. {k}/{w1} 1990 <citedRange>p. {k}</citedRange>"), "iconografia": _sql("{t} | 1/god/{w1}/top/held/{w2}/left | faint"),
}
Q["record_fields"] = "WITH p AS (SELECT p_partkey AS k, p_size AS s, p_type AS t, p_brand AS b, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part) " + " UNION ALL ".join(
    f"SELECT k AS id, '{f}' AS field, {e} AS value FROM p" for f, e in _EXPECTED.items()
)


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of parts as records, of which some lack a city, a region or a title."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("id"), F.when(k % 2 == 0, F.col("p_type")).when(k % 4 == 1, "").alias("citta"), F.when(k % 3 > 0, F.col("p_brand")).alias("regione"), F.when(k % 5 == 0, F.col("p_name")).otherwise("").alias("titolo"),
        F.when(k % 7 == 0, F.lit("da_compilare ")).otherwise(F.when(k % 7 == 1, F.lit(" ")).otherwise(F.col("p_name"))).alias("label"), F.when(k % 2 == 1, F.col("p_type")).alias("labelIt"),
        F.when(k % 3 == 0, F.concat(F.lit("XX-AB-0"), k, F.lit("_nr3.xml"))).otherwise(F.concat(F.lit("XX-ab-"), k)).alias("file"),
    )
    return rows.select(
        "id", text.record_label(F.when(F.col("id") % 6 > 0, F.col("id")), "ILA").alias("label"), text.place_name().alias("place"), text.shown_title().alias("title"), text.draft_label(F.col("file"), "XX").alias("draft"),
        text.vocabulary_label().alias("term"), text.translated(F.col("label"), {"red ring": "anello rosso"}).alias("value"), text.is_placeholder(F.col("label")).alias("open"),
    )


Q["labels"] = """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS citta, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS regione, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS titolo,
  CASE p_partkey % 7 WHEN 0 THEN 'da_compilare ' WHEN 1 THEN ' ' ELSE p_name END AS label, CASE WHEN p_partkey % 2 = 1 THEN p_type END AS it FROM part)
SELECT id, 'ILA ' || CASE WHEN id % 6 > 0 THEN CAST(id AS VARCHAR) ELSE '?' END AS label, coalesce(citta || ', ' || upper(regione), citta, regione, 'N/A') AS place, coalesce(titolo, citta, regione, 'Scheda #' || id) AS title,
  CASE WHEN id % 3 = 0 THEN 'AB ' || id ELSE 'XX-ab-' || id END AS draft, coalesce(it, label) AS term, CASE WHEN label = 'red ring' THEN 'Anello rosso' ELSE upper(label[1]) || label[2:] END AS value, id % 7 < 2 AS open FROM r"""

_EDITIONS: list = [
    '<ab><lb n="1"/>{w1} <supplied reason="lost">{w2}</supplied>', (2, 0, '<lb n="2" break="no"/>', '<lb n="2"/>'), "x", (3, 0, '<gap reason="lost" quantity="3" unit="character"/>', ""), (3, 1, '<gap reason="lost" extent="unknown"/>', ""),
    (5, 1, "<surplus>s</surplus>", ""), (5, 2, "<del>e</del>", ""), (5, 3, "<expan><abbr>a</abbr><ex>b</ex></expan>", ""), (4, 3, '<choice><sic>q</sic><corr>y</corr></choice>', ""), "</ab>",
]


def running_text(spark: SparkSession, d: str) -> DataFrame:
    """Editions put together from parts as running text with what is supplied, and with the sigla of printed editions."""
    rows = table(spark, d, "part").select("p_partkey", _composed(_EDITIONS).alias("edition"))
    printed = F.pandas_udf(lambda s: s.map(leiden), "string")
    shown = markup.searchable(rows, "p_partkey", "edition").select(F.col("p_partkey").alias("id"), "text", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",").alias("supplied"))
    return shown.join(rows.where("p_partkey % 4 <> 3").select(F.col("p_partkey").alias("id"), printed("edition").alias("printed")), "id", "left")


Q["running_text"] = r"""WITH p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
t AS (SELECT k, w1, w2, CASE k % 5 WHEN 1 THEN 's' WHEN 2 THEN 'e' WHEN 3 THEN 'ab' ELSE '' END AS a, CASE k % 5 WHEN 1 THEN '{s}' WHEN 2 THEN '⟦e⟧' WHEN 3 THEN 'a(b)' ELSE '' END AS b, CASE WHEN k % 4 = 3 THEN 'y' ELSE '' END AS y FROM p)
SELECT k AS id, w1 || ' ' || w2 || CASE WHEN k % 2 = 0 THEN '' ELSE ' ' END || 'x' || CASE WHEN k % 3 < 2 THEN CASE WHEN a || y = '' THEN ' […]' ELSE ' […] ' END ELSE '' END || a || y AS text,
  CAST(length(w1) + 1 AS VARCHAR) || '-' || CAST(length(w1) + 1 + length(w2) AS VARCHAR) AS supplied,
  CASE WHEN k % 4 <> 3 THEN w1 || ' [' || w2 || ']' || CASE WHEN k % 2 = 0 THEN '' ELSE chr(10) END || 'x' || CASE k % 3 WHEN 0 THEN '[···]' WHEN 1 THEN '[---]' ELSE '' END || b END AS printed FROM t"""


def edition_indices(spark: SparkSession, d: str) -> DataFrame:
    """What the persons of parts' editions suggest for the indices, and the first mention of each that has an id."""
    edition = _composed([
        '<persName type="divine" key="{w1}"><name>x</name></persName> <persName type="attested">{w2} <name>n</name></persName>', (2, 0, '<persName type="ruler" key="R{s}" xml:id="r"/>', '<persName type="emperor" xml:id="r">E {b}</persName>'),
        (3, 0, '<persName type="emperor" key="late" xml:id="r">y</persName>', ""), (4, 1, '<persName type="divine"><persName type="attested" key="in">z</persName></persName>', ""),
    ])
    found = markup.tokens(dealt(spark, d, "part", "p_partkey").withColumn("edition", edition), "p_partkey", "edition")
    return derive.edition_index(found, "p_partkey").select("p_partkey", "index", F.coalesce("value", F.lit("-")).alias("value"))


Q["edition_indices"] = """WITH p AS (SELECT p_partkey, p_partkey AS k, p_size, p_brand, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)
SELECT p_partkey, 'divinita' AS index, w1 AS value FROM p UNION SELECT p_partkey, 'onomastica', w2 || ' n' FROM p UNION SELECT p_partkey, 'imperatori', CASE WHEN k % 2 = 0 THEN 'R' || p_size ELSE 'E ' || p_brand END FROM p
UNION SELECT p_partkey, 'imperatori', 'late' FROM p WHERE k % 3 = 0 UNION SELECT p_partkey, x, v FROM p, (VALUES ('onomastica', 'in'), ('divinita', 'z')) AS t(x, v) WHERE k % 4 = 1
UNION SELECT p_partkey, 'person', CASE WHEN k % 2 = 0 THEN 'R' || p_size WHEN k % 3 = 0 THEN '-' ELSE '-' END FROM p"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Records with flags, lists and translations made of their columns."""
    even = F.col("id") % 2 == 0
    return records(spark, d).select(
        "*", even.alias("iscrizione"), (F.col("id") % 3 == 0).alias("anepigr"), F.array("materiale", F.when(even, F.lit("Soter"))).alias("epiteti"),
        F.array(F.struct(F.when(F.col("id") % 5 == 0, F.col("tipo")).otherwise(" ").alias("testo"))).alias("traduzioni"),
    )


def catalogue_flags(spark: SparkSession, d: str) -> DataFrame:
    """Records by flags, any of some epithets, regions and whether they are translated, each with the name of its filter."""
    rows = _marked(spark, d)
    asked = {
        "written": catalogue.CatalogueQuery(iscrizione=True, anepigr=False, dates=None), "translated": catalogue.CatalogueQuery(translated=True, anepigr=True, dates=None), "untranslated": catalogue.CatalogueQuery(translated=False, regioni=("ASIA", "EUROPE"), tipo="1-URGENT", dates=None),
        "epithets": catalogue.CatalogueQuery(epiteti=("Soter", "BUILDING"), tipo="2-HIGH", dates=(-300, 300)),
    }
    parts = [q.apply(rows).select(F.lit(name).alias("filter"), "id") for name, q in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


Q["catalogue_flags"] = f"""WITH {RECORDS} SELECT 'written' AS filter, id FROM records WHERE id % 2 = 0 AND id % 3 <> 0 UNION ALL SELECT 'translated', id FROM records WHERE id % 5 = 0 AND id % 3 = 0
UNION ALL SELECT 'untranslated', id FROM records WHERE id % 5 <> 0 AND regione IN ('ASIA', 'EUROPE') AND tipo = '1-URGENT'
UNION ALL SELECT 'epithets', id FROM records WHERE (id % 2 = 0 OR materiale = 'BUILDING') AND tipo = '2-HIGH' AND (data_inizio IS NULL OR data_inizio = 0 OR data_fine IS NULL OR data_fine = 0 OR data_inizio >= -300 AND data_fine <= 300)"""


def catalogue_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents' languages and sources as records, kept where a search finds their text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("regione"), F.col("source").alias("citta"))
    hits = search.search(_index(spark, d), "that this", every=True, prefix=False, fuzzy=0)
    return catalogue.CatalogueQuery(citta="src3", dates=None).apply(docs, hits).select("id", "regione")


Q["catalogue_hits"] = r"""WITH t AS (SELECT doc_id, lang, source, regexp_extract_all(lower(replace(strip_accents(text), 'ς', 'σ')), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id AS id, lang AS regione FROM t WHERE source = 'src3' AND list_contains(w, 'that') AND list_contains(w, 'this')"""


def editor_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of the editor's lists: what contains a text, what completes one, ledger entries of a status, drafts."""
    part, c = table(spark, d, "part"), table(spark, d, "customer")
    quick = catalogue.quick_filter(part.withColumnRenamed("p_partkey", "id"), "RING", "p_name", "p_type", most=80).select(F.lit("quick").alias("list"), F.col("id").cast("string").alias("item"))
    done = catalogue.completions(part, "p_name", "IN", F.array(F.lit("red ring"))).select(F.lit("completion").alias("list"), F.col("label").alias("item"))
    notes = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "open").otherwise("resolved").alias("status"), F.col("c_acctbal").alias("createdAt"))
    newest = catalogue.with_status(notes, "resolved").limit(20).select(F.lit("resolved").alias("list"), F.col("id").cast("string").alias("item"))
    names = mutate.draft_matches(c.select(F.col("c_name").alias("filename")), table(spark, d, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("filename")), "filename")
    drafts = catalogue.drafts(names, True).limit(7).select(F.lit("draft").alias("list"), F.col("filename").alias("item"))
    return quick.unionByName(done).unionByName(newest).unionByName(drafts)


Q["editor_lists"] = """SELECT * FROM (SELECT 'quick' AS list, CAST(p_partkey AS VARCHAR) AS item FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') ORDER BY p_partkey LIMIT 80)
UNION ALL SELECT * FROM (SELECT DISTINCT 'completion', p_name FROM part WHERE contains(lower(p_name), 'in') AND p_name <> 'red ring' ORDER BY 2 LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'resolved', CAST(c_custkey AS VARCHAR) FROM customer WHERE NOT coalesce(c_acctbal > 0, false) ORDER BY c_acctbal DESC, c_custkey LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'draft', c_name FROM customer WHERE c_name IN (SELECT replace(s_name, 'Supplier', 'Customer') FROM supplier) ORDER BY 2 LIMIT 7)"""


def ledger_records(spark: SparkSession, d: str) -> DataFrame:
    """Ledger entries by entry id, else by number, with the first rule that an entry's note breaks."""
    k = F.col("p_partkey")
    entry = F.when(k % 3 == 0, F.concat(F.lit("e"), F.col("p_size"))).when(k % 3 == 1, k.cast("string")).otherwise("none")
    note = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.repeat(F.lit("x"), (k % 50 + 3970).cast("int"))).otherwise(F.col("p_name"))
    entries = table(spark, d, "part").select(entry.alias("entryId"), k.alias("n"), note.alias("note"), F.repeat(F.col("p_type"), (k % 20).cast("int")).alias("author"), F.when(k % 7 == 0, "closed").otherwise("open").alias("status"))
    known = table(spark, d, "supplier").select(F.concat(F.lit("e"), F.col("s_suppkey") % 40).alias("entryId"), F.col("s_suppkey").alias("id"))
    return mutate.ledger_of_record(entries, known).select("n", "record_id", rules.note_rules("note", "author", "status").alias("violation"))


Q["ledger_records"] = """WITH e AS (SELECT p_partkey AS n, CASE p_partkey % 3 WHEN 0 THEN 'e' || p_size WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'none' END AS entry, p_partkey % 20 * length(p_type) AS author FROM part),
k AS (SELECT 'e' || (s_suppkey % 40) AS entry, min(s_suppkey) AS id FROM supplier GROUP BY 1)
SELECT n, coalesce(k.id, s.s_suppkey) AS record_id, CASE WHEN n % 5 = 0 THEN 'note empty' WHEN n % 5 = 1 AND n % 50 + 3970 > 4000 THEN 'note longer than 4000' WHEN author > 100 THEN 'author longer than 100' WHEN n % 7 = 0 THEN 'status unknown' END AS violation
FROM e LEFT JOIN k ON e.entry = k.entry LEFT JOIN supplier AS s ON e.entry = CAST(s.s_suppkey AS VARCHAR)"""


def index_reports(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of several indices in one pass, their sums, distinct epithets of each deity, and the reach of each drawing."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.array(F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("divinita"), F.array("p_type", F.initcap("p_type")).alias("epiteti"), F.when(k % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("citta"),
        F.array(F.struct(F.col("p_type").alias("divinita"), F.array("p_brand", F.lit("Soter")).alias("epiteti"))).alias("divinitaEpiteti"),
    )
    found = statistics.variant_reports(rows, text.fold, ("divinita", "epiteti", "citta"))
    listed = found.select("report", "key", F.col("n_variants").cast("long").alias("n"), "variants")
    sums = statistics.conflicts(found).select(F.coalesce("report", F.lit("all")).alias("report"), F.lit("conflicts").alias("key"), "n", F.lit(None).cast("string").alias("variants"))
    epithets = statistics.distinct_epithets(rows).select(F.lit("epithets").alias("report"), F.coalesce("divinita", F.lit("all")).alias("key"), "n", F.lit(None).cast("string").alias("variants"))
    boxes = records(spark, d).where("data_inizio <> 0").groupBy("citta", timeline.bucket(F.col("data_inizio"), 50).alias("bucket")).agg(F.count("*").alias("n"))
    drawn = timeline.two_sided(boxes.withColumn("left", F.col("bucket") * 100.0), "citta", key="bucket", left="left", n="n")  # boxes don't meet: one lane
    reach = timeline.vertical_reach(drawn, "citta", "n").select(F.lit("reach").alias("report"), F.col("citta").alias("key"), F.col("reach").cast("long").alias("n"), F.lit(None).cast("string").alias("variants"))
    return listed.unionByName(sums).unionByName(epithets).unionByName(reach)


Q["index_reports"] = f"""WITH {RECORDS}, v AS (SELECT 'divinita' AS report, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS v FROM part UNION ALL SELECT 'epiteti', unnest(list_distinct([p_type, upper(p_type[1]) || lower(p_type[2:])])) FROM part
  UNION ALL SELECT 'citta', CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END FROM part),
c AS (SELECT report, lower(v) AS key, v, count(*) AS k FROM v GROUP BY 1, 2, 3), f AS (SELECT report, key, count(*) AS n, string_agg(v, '|' ORDER BY k DESC, v) AS variants FROM c GROUP BY 1, 2 HAVING count(*) > 1),
b AS (SELECT citta, CAST(floor(data_inizio / 50.0 + 0.5) * 50 AS BIGINT) AS bucket, count(*) AS n FROM records WHERE data_inizio <> 0 GROUP BY 1, 2)
SELECT report, key, n, variants FROM f UNION ALL SELECT coalesce(report, 'all'), 'conflicts', count(*), NULL FROM f GROUP BY ROLLUP (report)
UNION ALL SELECT 'epithets', coalesce(p_type, 'all'), count(DISTINCT e), NULL FROM (SELECT p_type, unnest([p_brand, 'Soter']) AS e FROM part) GROUP BY ROLLUP (p_type)
UNION ALL SELECT 'reach', citta, max(20 + CASE WHEN n <= 1 THEN 42 ELSE 36 + least(n * 40, 108) END) + 40, NULL FROM b GROUP BY citta"""


def iconography_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records with figures: the distinct functions, places and traits, and each figure's traits by kind."""
    k = F.col("p_partkey")
    trait = lambda kind, key: F.struct(F.lit(kind).alias("type"), key.alias("key"))
    w = [F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2)]
    first = F.struct(F.lit(1).alias("n"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("place"), F.array(trait("held", w[1]), trait("held", w[0]), trait("worn", F.col("p_type"))).alias("traits"))
    second = F.struct(F.lit(2).alias("n"), F.lit("below").alias("place"), F.array(trait("worn", w[0])).alias("traits"))
    ico = F.struct(F.when(k % 5 > 0, F.col("p_type")).alias("function"), F.when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("figures"))
    rows = table(spark, d, "part").select(k.alias("id"), F.when(k % 7 > 0, ico).alias("iconografia"))
    facets = catalogue.nested_facets(rows).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("n"), "facet", "value")
    return facets.unionByName(derive.grouped_traits(rows, "id").select("id", "n", F.col("type").alias("facet"), F.array_join("traits", ",").alias("value")))


Q["iconography_lists"] = """WITH p AS (SELECT p_partkey AS id, p_type AS t, p_brand AS b, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part WHERE p_partkey % 7 > 0),
f AS (SELECT 'function' AS facet, t AS value FROM p WHERE id % 5 > 0 UNION SELECT 'place', b FROM p WHERE id % 2 = 0 UNION SELECT 'place', 'below' FROM p WHERE id % 3 = 0 UNION SELECT 'trait', unnest([w1, w2, t]) FROM p)
SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS INTEGER) AS n, facet, value FROM f UNION ALL SELECT id, 1, 'held', least(w1, w2) || ',' || greatest(w1, w2) FROM p UNION ALL SELECT id, 1, 'worn', t FROM p UNION ALL SELECT id, 2, 'worn', w1 FROM p WHERE id % 3 = 0"""

QUERIES = [record_fields, labels, running_text, edition_indices, catalogue_flags, catalogue_hits, editor_lists, ledger_records, index_reports, iconography_lists]
