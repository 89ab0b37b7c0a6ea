"""Queries of text functions, search, markup, extraction and sources."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import markup, records as xml, search, segments
from corpusloom.plans.views import RECORDS, records, spread, table
from corpusloom.sources import corpus
from corpusloom.sources.versions import fingerprint, shared_folder
from corpusloom.streaming import changes

Q: dict[str, str] = {}


def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


Q["fold_text"] = "SELECT doc_id, lower(replace(strip_accents(text), 'ς', 'σ')) AS folded FROM documents"


def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("shown"), text.strip_tags(F.col("html"), " ").alias("indexed"))


Q["strip_markup"] = r"""SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS shown, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS indexed FROM pages"""


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("sha256"))


Q["content_hash"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"


def unescape_entities(spark: SparkSession, d: str) -> DataFrame:
    twice = F.replace(F.col("html"), F.lit("&"), F.lit("&amp;"))
    return spread(spark, d, "pages").select("page_id", text.unescape_xml(twice).alias("amp_first"), text.unescape_xml(twice, ampersand_first=False).alias("amp_last"))


_REST = ["'&lt;', '<'", "'&gt;', '>'", "'&quot;', '\"'", "'&apos;', ''''"]


def _replaced(c: str, pairs: list[str]) -> str:
    for p in pairs:
        c = f"replace({c}, {p})"
    return c


Q["unescape_entities"] = f"""SELECT page_id, {_replaced("replace(html, '&', '&amp;')", ["'&amp;', '&'", *_REST])} AS amp_first, {_replaced("replace(html, '&', '&amp;')", [*_REST, "'&amp;', '&'"])} AS amp_last FROM pages"""


def entry_keys(spark: SparkSession, d: str) -> DataFrame:
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", text.entry_id(title).alias("key"), text.file_name(F.col("doc_id")).alias("file"))


Q["entry_keys"] = r"""WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(strip_accents(split_part(text, chr(10), 1)), '[^A-Za-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') AS key FROM documents)
SELECT doc_id, substring(CASE WHEN key = '' THEN 'entry' ELSE key END, 1, 128) AS key, CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END || '.xml' AS file FROM k"""


def highlight(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d, "documents").select("doc_id", text.highlight(F.col("text"), "the and tion").alias("shown"))


Q["highlight"] = r"SELECT doc_id, regexp_replace(text, '(?i)(the|tion)', '<mark>\1</mark>', 'g') AS shown FROM documents"

FIELDS = {"text": 1.0, "source": 0.5}


def kept_index(spark: SparkSession, d: str, name: str, rows: DataFrame, fields: dict[str, float], tables: tuple[str, ...], *, id: str = "id") -> search.Index:  # noqa: A002
    """The index of rows, kept in the session's shared folder and brought up to date if a file of its tables has changed."""
    where = hashlib.sha256(d.encode()).hexdigest()[:16]
    index = segments.SegmentIndex(spark, f"{shared_folder(spark)}/index-{name}-{where}", fields)
    source = f"{fingerprint(spark, [f'{d}/{t}.parquet' for t in tables])}/{sorted(fields)}"
    if index.state()[1]["source"] != source:
        index.update(rows, id=id, source=source)
    return index.open()


def _index(spark: SparkSession, d: str) -> search.Index:
    return kept_index(spark, d, "documents", table(spark, d, "documents"), FIELDS, ("documents",), id="doc_id")


def _found(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "n_words")


_FIELDS_SQL = "SELECT doc_id AS id, 'text' AS field, 1.0 AS boost, lower(replace(strip_accents(text), 'ς', 'σ')) AS t FROM documents UNION ALL SELECT doc_id, 'source', 0.5, lower(source) FROM documents"


def _search_sql(words: list[str], every: bool, weight: str) -> str:
    asked = " UNION ALL ".join(f"SELECT '{w}' AS word" for w in words)
    having = f"HAVING count(DISTINCT word) = {len(words)}" if every else ""
    return rf"""WITH f AS ({_FIELDS_SQL}),
a AS (SELECT id, field, boost, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS terms FROM f),
p AS (SELECT id, field, boost, len(terms) AS size, unnest(terms) AS term FROM a),
i AS (SELECT id, field, boost, size, term, count(*) AS tf FROM p GROUP BY ALL),
m AS (SELECT field, avg(size) AS mean FROM (SELECT DISTINCT id, field, size FROM i) GROUP BY 1), n AS (SELECT count(DISTINCT id) AS total FROM i),
q AS ({asked}), v AS (SELECT DISTINCT term FROM i),
e AS (SELECT word, term, {weight} AS weight FROM v, q), x AS (SELECT i.*, word, weight FROM i JOIN e USING (term) WHERE weight IS NOT NULL),
df AS (SELECT field, term, count(*) AS df FROM (SELECT DISTINCT id, field, term FROM x) GROUP BY 1, 2)
SELECT id AS doc_id, round(sum(boost * weight * ln(1 + (total - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * size / mean)))), 4) AS score, count(DISTINCT word) AS n_words
FROM x JOIN df USING (field, term) JOIN m USING (field), n GROUP BY 1 {having}"""


_EQUAL = "CASE WHEN term = word THEN 1.0 END"
_PREFIX = "CASE WHEN term = word THEN 1.0 WHEN starts_with(term, word) THEN 0.375 * length(word) / (length(word) + 0.3 * (length(term) - length(word))) END"
_FUZZY = "CASE WHEN term = word THEN 1.0 WHEN abs(length(term) - length(word)) <= floor(0.2 * length(word) + 0.5) AND levenshtein(term, word) <= floor(0.2 * length(word) + 0.5) THEN 0.45 * length(word) / (length(word) + levenshtein(term, word)) END"


def search_or(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(_index(spark, d), "Thé réau ciónes", prefix=False, fuzzy=0))


Q["search_or"] = _search_sql(["the", "reau", "ciones"], False, _EQUAL)


def search_and(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(_index(spark, d), "that this src3", every=True, prefix=False, fuzzy=0))


Q["search_and"] = _search_sql(["that", "this", "src3"], True, _EQUAL)


def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(_index(spark, d), "thou ciónd", prefix=True, fuzzy=0))


Q["search_prefix"] = _search_sql(["thou", "ciond"], False, _PREFIX)


def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(_index(spark, d), "thention eauouon", prefix=False, fuzzy=0.2))


Q["search_fuzzy"] = _search_sql(["thention", "eauouon"], False, _FUZZY)


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Records with a title, lists and nested fields, as the catalogue's index takes them."""
    figure = F.struct(F.lit("god").alias("type"), F.lower("materiale").alias("key"), F.array(F.struct(F.lit("held").alias("type"), F.lit("patera").alias("key"))).alias("traits"))
    return records(spark, d, spread).select(
        "id", "citta", "regione", "tipo", "materiale", F.concat_ws(" ", F.lit("Stele"), "citta").alias("titolo"), F.array("materiale", F.lit("Soter")).alias("epiteti"),
        F.array(F.struct(F.col("tipo").alias("testo"), F.lit("to Building").alias("note"))).alias("traduzioni"), F.concat(F.lit("<b>Seen</b> in "), "regione").alias("note_interne"),
        F.struct(F.lit("votive").alias("function"), F.array(figure).alias("figures"), F.lit(None).cast("string").alias("note")).alias("iconografia"),
    )


LABELS = {"votive": "votivo", "patera": "coppa", "god": "dio"}


def search_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Over the fifteen fields with their boosts."""
    texts = search.indexed_texts(_catalogue(spark, d), LABELS)
    index = kept_index(spark, d, "catalogue", texts, search.FIELD_BOOST, ("orders", "customer", "nation", "region"))
    found = search.search(index, "Building europe coppa", prefix=False, fuzzy=0)
    return found.select("id", F.round("score", 4).alias("score"), "n_words")


_TEXTS = {
    "citta": (1.0, "citta"), "regione": (1.0, "regione"), "tipo": (1.0, "tipo"), "materiale": (0.5, "materiale"), "titolo": (1.5, "'Stele ' || citta"), "epiteti": (2.5, "materiale || ' Soter'"),
    "traduzioni": (1.0, "tipo || ' to Building'"), "note_interne": (0.5, "'Seen in ' || regione"), "iconografia": (1.0, "'votive votivo ' || lower(materiale) || ' dio patera coppa'"),
}
_SOURCE = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {b} AS boost, lower({x}) AS t FROM records" for f, (b, x) in _TEXTS.items())
Q["search_catalogue"] = _search_sql(["building", "coppa", "europe"], False, _EQUAL).replace("WITH f AS (" + _FIELDS_SQL + ")", f"WITH {RECORDS}, f AS ({_SOURCE})").replace("id AS doc_id", "id")


def marked_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.posexplode(markup.spans(F.col("html"), "a")).alias("nth", "span"))
    return rows.select("page_id", F.col("nth").cast("long").alias("nth"), text.strip_tags(F.col("span")).alias("span"))


Q["marked_spans"] = r"""WITH s AS (SELECT page_id, regexp_extract_all(html, '(?s)<a(?:\s[^>]*)?>(.*?)</a>', 1) AS x FROM pages), e AS (SELECT page_id, unnest(range(len(x))) AS nth, unnest(x) AS span FROM s)
SELECT page_id, nth, regexp_replace(span, '<[^>]+>', '', 'g') AS span FROM e"""


def match_in_span(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page's first link text also occurs among the characters 100 to 300 of the shown text."""
    shown = table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("shown"), F.get(markup.spans(F.col("html"), "a"), F.lit(0)).alias("needle"))
    span = F.array(F.struct(F.lit(100).alias("s"), F.lit(300).alias("e")))
    rows = shown.where(F.length("needle") > 0).withColumn("ranges", span)
    return rows.select("page_id", search.falls_in_span("needle", "ranges", "shown").alias("in_span"))


Q["match_in_span"] = r"""WITH s AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS shown, regexp_extract_all(html, '(?s)<a(?:\s[^>]*)?>(.*?)</a>', 1)[1] AS needle FROM pages)
SELECT page_id, len(list_filter(range(1, length(shown) + 1), lambda i: substring(shown, i, length(needle)) = needle AND i - 1 < 300 AND i - 1 + length(needle) > 100)) > 0 AS in_span FROM s WHERE length(needle) > 0"""


def tokenize_markup(spark: SparkSession, d: str) -> DataFrame:
    found = markup.tokens(spread(spark, d, "pages"), "page_id", "html")
    return found.select("page_id", "error", F.size("tokens").cast("long").alias("n_tokens"))


#: Editions, each of which breaks the rules that the SQL names, or none.
EDITIONS = [
    '<ab><lb n="1"/>abc</ab>',
    '<ab><lb n="1"/>a [bc]</ab>',
    '<lb n="1"/>a <gap/> b',
    '<lb n="1"/><gap quantity="0" unit="character"/>',
    '<lb n="1"/><gap quantity="2" unit="characteρ"/>',
    '<lb n="1"/><gap quantity="2" unit="letter"/>',
    '<lb n="1" break="no"/>abc',
    '<lb n="1"/>ab-<lb n="2"/>cd',
    '<lb n="1"/><persName type="attested" nymRef="x">y</persName>',
    '<lb n="1"/>a<lb n="2"/><rs type="epithet">b</rs>',
    '<lb n="1"/><persName type="divine" key="A">a</persName> <persName type="divine" key="B">b</persName> <rs type="epithet">c</rs>',
    '<lb n="1"/><persName type="divine">a</persName>',
    '<lb n="1"/><persName type="divine" key="A"><rs type="epithet" key="k" nymRef="n">b</rs></persName>',
    '<lb n="1"/><persName type="ruler" key="Some Theos"><name>E</name><rs type="epithet">theou</rs></persName>',
    '<lb n="1"/><rs type="office">x</rs>',
    '<lb n="1"/>a <hi rend="">b</hi>',
    '<lb n="1"/>a<lb/> n="2"/>abc',
    '<ab><lb n="1"/>abc</x></ab>',
]


def edition_issues(spark: SparkSession, d: str) -> DataFrame:
    """Parts with one of the editions each."""
    edition = F.element_at(F.array(*map(F.lit, EDITIONS)), (F.col("p_partkey") % len(EDITIONS) + 1).cast("int"))
    found = markup.tokens(spread(spark, d, "part").withColumn("edition", edition), "p_partkey", "edition")
    return markup.edition_issues(found, "p_partkey")


Q["edition_issues"] = """SELECT p_partkey, line, rule, severity FROM part JOIN (VALUES (1, 1, 'leiden_residue', 'warning'), (2, 1, 'gap_without_extent', 'error'), (3, 1, 'gap_of_zero', 'error'), (4, 1, 'unit_not_ascii', 'error'), (5, 1, 'unit_unknown', 'error'),
  (6, 1, 'first_line_continues', 'error'), (7, 1, 'hyphen_before_line', 'warning'), (8, 1, 'nymref_on_person', 'error'), (9, 2, 'epithet_outside_person', 'error'), (10, 1, 'epithet_after_coordinated', 'warning'), (11, 1, 'divine_without_key', 'warning'),
  (12, 1, 'divine_without_name', 'warning'), (12, 1, 'nymref_on_epithet', 'error'), (12, 1, 'key_on_epithet', 'error'), (13, 1, 'epithet_in_key', 'warning'), (14, 1, 'office_without_key', 'warning'), (15, 1, 'empty_attribute', 'error'), (16, 2, 'attribute_in_text', 'error'), (17, 0, 'not_well_formed', 'error')
) AS v(k, line, rule, severity) ON p_partkey % 18 = k"""


def nesting_scan(spark: SparkSession, d: str) -> DataFrame:
    return markup.outside(markup.tags(spread(spark, d, "pages"), "page_id", "html"), "page_id", "p", "article")


_TAGS = r"""t AS (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*?)(/?)>', 0) AS x FROM pages)),
g AS (SELECT page_id, pos, lower(regexp_extract(tag, '^</?([A-Za-z0-9]+)', 1)) AS name, CASE WHEN starts_with(tag, '</') THEN -1 WHEN ends_with(tag, '/>') THEN 0 ELSE 1 END AS step FROM t)"""
Q["nesting_scan"] = f"""WITH {_TAGS}, w AS (SELECT *, coalesce(sum(CASE WHEN name = 'article' THEN step END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM g)
SELECT page_id, count(*) AS n_inner, count(*) FILTER (WHERE depth <= 0) AS n_outside FROM w WHERE name = 'p' AND step >= 0 GROUP BY 1"""


def tag_balance(spark: SparkSession, d: str) -> DataFrame:
    return markup.balance(markup.tags(spread(spark, d, "pages"), "page_id", "html"), "page_id")


Q["tag_balance"] = f"""WITH {_TAGS} SELECT page_id, name, count(*) FILTER (WHERE step = 1) AS open, count(*) FILTER (WHERE step = -1) AS closed FROM g
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE step = 1) <> count(*) FILTER (WHERE step = -1)"""


def markup_rules(spark: SparkSession, d: str) -> DataFrame:
    return markup.issues(spread(spark, d, "pages"), "page_id", "html")


Q["markup_rules"] = r"""WITH r AS (SELECT * FROM (VALUES ('square', '\[[^\]<>]*\]'), ('angle', '⟨[^⟩]*⟩'), ('double', '⟦[^⟧]*⟧'), ('braces', '\{[^}<>]*\}'), ('dots', '\.\.\.|…'), ('hyphen', '-\s*<lb\b')) AS v(rule, pattern))
SELECT page_id, rule FROM pages, r WHERE regexp_matches(html, pattern)"""


def line_diff(spark: SparkSession, d: str) -> DataFrame:
    """Each document against itself without repeated lines and those that end in a full stop, between two new lines."""
    docs = table(spark, d, "documents")
    kept = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: ~F.endswith(x, F.lit(".")))
    after = F.array_join(F.concat(F.array(F.lit("<first>")), kept, F.array(F.lit("<last>"))), "\n")
    return markup.line_diff(docs.withColumn("after", after), "doc_id", "text", "after")


Q["line_diff"] = """WITH k AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, len(list_filter(list_distinct(string_split(text, chr(10))), lambda x: NOT ends_with(x, '.'))) AS same FROM documents)
SELECT doc_id, 2 AS n_added, n - same AS n_removed, same AS n_same FROM k"""


def backup_concat(spark: SparkSession, d: str) -> DataFrame:
    return corpus.blocks(table(spark, d, "documents"), "doc_id", "text")


Q["backup_concat"] = "SELECT doc_id, replace('  ' || text, chr(10), chr(10) || '  ') AS block FROM documents"


def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as one-file snapshots, read back."""
    docs = table(spark, d, "pages")
    packed = docs.select(F.to_json(F.struct(F.lit("2024-01-01").alias("generatedAt"), F.create_map("url", "html").alias("files"))).alias("json"))
    return corpus.files_of(packed, "json")


Q["snapshot_files"] = "SELECT url AS file, html AS xml FROM pages"


def sniff_format(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.concat(F.lit("<e>"), "props", F.lit("</e>"))).alias("content"))
    return corpus.sniffed(rows, "content").groupBy("format").agg(F.count("*").alias("n"))


Q["sniff_format"] = "SELECT CASE WHEN event_type = 'click' THEN 'json' ELSE 'xml' END AS format, count(*) AS n FROM events GROUP BY 1"


def record_extract(spark: SparkSession, d: str) -> DataFrame:
    """Records written as XML, two to a file, split and read again; a date with a lower bound only is that year."""
    rows = records(spark, d, spread).withColumn("titolo", F.concat_ws(" & ", "citta", "tipo")).withColumn("entryId", F.concat(F.lit("e"), F.col("id").cast("string")))
    tei = xml.to_xml(rows)
    files = tei.withColumn("xml", F.concat(F.lit("<teiCorpus>"), "tei", F.lit("\n"), F.replace("tei", F.lit('<idno type="id">'), F.lit('<idno type="id">9')), F.lit("</teiCorpus>"))).select("xml")
    found = xml.extract(xml.split_records(files), keep=("part",))
    return found.select(F.col("part").cast("long").alias("part"), "id", "titolo", "tipo", "materiale", "citta", "regione", F.col("data_inizio").cast("long").alias("data_inizio"), F.col("data_fine").cast("long").alias("data_fine"))


Q["record_extract"] = f"""WITH {RECORDS} SELECT part, CASE WHEN part = 0 THEN id ELSE CAST('9' || id AS BIGINT) END AS id, citta || ' & ' || tipo AS titolo, tipo, materiale, citta, regione, data_inizio, coalesce(data_fine, data_inizio) AS data_fine FROM records, range(2) AS p(part)"""


def burst_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.bursts(e, "user_id", "ts", "30 minutes").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


Q["burst_sessions"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = [
    fold_text, strip_markup, content_hash, unescape_entities, entry_keys, highlight, search_or, search_and, search_prefix, search_fuzzy, search_catalogue, marked_spans, match_in_span, tokenize_markup, edition_issues, nesting_scan,
    tag_balance, markup_rules, line_diff, backup_concat, snapshot_files, sniff_format, record_extract, burst_sessions,
]
