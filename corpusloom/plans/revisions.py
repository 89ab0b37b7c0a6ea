"""Queries of what changes: indexes that follow their tables, versions side by side, lanes on two sides, names in a language's order."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import catalogue, imports, markup, mutate, search, segments, timeline
from corpusloom.plans.texts import _EQUAL, _FIELDS_SQL, _index, _search_sql
from corpusloom.plans.views import RECORDS, dealt, records, table
from corpusloom.sources import corpus
from corpusloom.sources.versions import shared_folder

Q: dict[str, str] = {}


def search_updated(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose index was made of other rows (some changed, some not there yet, some since deleted) and then brought up to date."""
    fields = {"p_name": 2.0, "p_type": 1.0}
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_name", "p_type")
    key = F.col("id")
    earlier = parts.where(key % 5 != 1).withColumn("p_name", F.when(key % 3 == 0, F.concat_ws(" ", "p_type", F.lit("small small"), "p_name")).otherwise(F.col("p_name")))
    earlier = earlier.unionByName(parts.where(key % 7 == 0).select((-key - 1).alias("id"), F.lit("small hot ring").alias("p_name"), "p_type"))
    where = hashlib.sha256(d.encode()).hexdigest()[:16]
    index = segments.SegmentIndex(spark, f"{shared_folder(spark)}/index-parts-{where}", fields)
    for rows in (earlier, parts):
        index.update(rows)
    index.compact()
    found = search.search(index.open(), "small ring economy", prefix=False, fuzzy=0)
    return found.select("id", F.round("score", 4).alias("score"), "n_words")


_PARTS = "SELECT CAST(p_partkey AS BIGINT) AS id, 'p_name' AS field, 2.0 AS boost, lower(p_name) AS t FROM part UNION ALL SELECT p_partkey, 'p_type', 1.0, lower(p_type) FROM part"
Q["search_updated"] = _search_sql(["small", "ring", "economy"], False, _EQUAL).replace(_FIELDS_SQL, _PARTS).replace("id AS doc_id", "id")


def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines, each numbered, against a version in which some are gone, some altered and some new."""
    line, n = F.col("x.line"), F.col("x.n")
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(" "), x))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", numbered.alias("before"))

    def revised(x, i):
        size = F.length(x) + i
        kept = F.when(size % 5 == 0, F.array().cast("array<string>")).when(size % 7 == 1, F.array(F.concat(F.lit("altered "), x))).otherwise(F.array(x))
        return F.when(size % 3 == 0, F.concat(kept, F.array(F.concat(F.lit("new "), i.cast("string"))))).otherwise(kept)

    pairs = docs.select("doc_id", F.array_join("before", "\n").alias("before"), F.array_join(F.flatten(F.transform("before", revised)), "\n").alias("after"))
    return markup.diff_rows(pairs, "doc_id", "before", "after")


Q["diff_rows"] = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, i || ' ' || x AS line, (length(i || ' ' || x) + i) AS size FROM l),
o AS (SELECT doc_id, i, size, CASE WHEN size % 5 = 0 THEN NULL WHEN size % 7 = 1 THEN 'altered ' || line ELSE line END AS new, 0 AS sub FROM n UNION ALL SELECT doc_id, i, size, 'new ' || i, 1 FROM n WHERE size % 3 = 0),
r AS (SELECT doc_id, i, sub, new AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i, sub) AS right_no, sub = 0 AND size % 7 <> 1 AS same FROM o WHERE new IS NOT NULL),
e AS (SELECT doc_id, i, line, i + 1 AS left_no, size % 5 <> 0 AND size % 7 <> 1 AS same FROM n),
s AS (SELECT doc_id, line, left_no, NULL AS right_no, same, count(*) FILTER (WHERE same) OVER (PARTITION BY doc_id ORDER BY left_no) AS gap FROM e),
t AS (SELECT doc_id, line, right_no, same, count(*) FILTER (WHERE same) OVER (PARTITION BY doc_id ORDER BY right_no) AS gap FROM r),
a AS (SELECT doc_id, gap, left_no, line, row_number() OVER (PARTITION BY doc_id, gap ORDER BY left_no) AS nth FROM s WHERE NOT same),
b AS (SELECT doc_id, gap, right_no, line, row_number() OVER (PARTITION BY doc_id, gap ORDER BY right_no) AS nth FROM t WHERE NOT same),
u AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.gap, b.gap) AS gap, coalesce(a.nth, b.nth) AS nth, left_no, right_no, a.line AS "left", b.line AS "right", CASE WHEN left_no IS NULL THEN 'added' ELSE 'removed' END AS kind
  FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.gap = b.gap AND a.nth = b.nth
  UNION ALL SELECT s.doc_id, s.gap, 0, s.left_no, t.right_no, s.line, t.line, 'same' FROM s JOIN t ON s.doc_id = t.doc_id AND s.gap = t.gap AND s.same AND t.same)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gap, nth) AS row, left_no, right_no, "left", "right", kind FROM u"""


def two_sided_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Places' records in boxes of ten years, on both sides of each place's axis."""
    rows = records(spark, d).where("data_inizio <> 0").withColumn("bucket", timeline.bucket(F.col("data_inizio"), 10))
    boxes = rows.groupBy("citta", "bucket").agg(F.count("*").alias("n"), (F.col("bucket") * 2.5).cast("double").alias("left"))
    return timeline.two_sided(boxes, "citta", key="bucket", left="left", n="n")


Q["two_sided_lanes"] = f"""WITH RECURSIVE {RECORDS}, c AS (SELECT citta, CAST(floor(data_inizio / 10.0 + 0.5) * 10 AS BIGINT) AS bucket, count(*) AS n FROM records WHERE data_inizio <> 0 GROUP BY 1, 2),
o AS (SELECT *, bucket * 2.5 AS x, row_number() OVER (PARTITION BY citta ORDER BY bucket) - 1 AS place FROM c),
r AS (SELECT citta, CAST(-1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS up, CAST([] AS DOUBLE[]) AS down, '' AS side, CAST(0 AS BIGINT) AS lane FROM (SELECT DISTINCT citta FROM o)
  UNION ALL SELECT citta, place, bucket, n, CASE WHEN is_up THEN list_concat(list_concat(up[1:a], [x + 86]), up[a + 2:]) ELSE up END, CASE WHEN is_up THEN down ELSE list_concat(list_concat(down[1:b], [x + 86]), down[b + 2:]) END,
    CASE WHEN is_up THEN 'up' ELSE 'down' END, CASE WHEN is_up THEN a ELSE b END
  FROM (SELECT *, a < b OR a = b AND place % 2 = 0 AS is_up FROM (SELECT o.*, up, down, coalesce(nullif(list_position(list_transform(up, lambda e: x - 86 >= e + 12), true), 0) - 1, len(up)) AS a,
    coalesce(nullif(list_position(list_transform(down, lambda e: x - 86 >= e + 12), true), 0) - 1, len(down)) AS b FROM r JOIN o ON o.citta = r.citta AND o.place = r.place + 1))),
h AS (SELECT citta, side, lane, max(CASE WHEN n <= 1 THEN 42 ELSE 36 + least(n * 40, 108) END) + 14 AS high FROM r WHERE place >= 0 GROUP BY ALL),
f AS (SELECT citta, side, lane, coalesce(sum(high) OVER (PARTITION BY citta, side ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_ FROM h)
SELECT citta, bucket, n, place, side, CAST(lane AS INTEGER) AS lane, CAST(20 + offset_ AS BIGINT) AS connector, CAST(least(34, 12 + lane * 7) * CASE WHEN place % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS bend
FROM r JOIN f USING (citta, side, lane) WHERE place >= 0"""

_SPELT = [("aeiou", "àéîõü"), ("aeiou", "AEIOU"), ("rst", "RST"), ("ao", "áò"), ("", "")]


def collated_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names, spelt with accents and capitals by their numbers, in the order of the catalogue's language within each kind."""
    case = F.col("p_partkey") % len(_SPELT)
    spelt = F.coalesce(*(F.when(case == i, F.translate("p_name", a, b)) for i, (a, b) in enumerate(_SPELT)))
    names = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.concat(spelt, F.lit(" "), F.col("p_brand")).alias("name")).distinct()
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("kind").orderBy(catalogue.collated(F.col("name"))))
    return names.select("kind", "name", place.cast("long").alias("place"))


_SPELT_SQL = " ".join(f"WHEN {i} THEN " + (f"translate(p_name, '{a}', '{b}')" if a else "p_name") for i, (a, b) in enumerate(_SPELT))
Q["collated_names"] = f"""WITH n AS (SELECT DISTINCT p_type AS kind, (CASE p_partkey % {len(_SPELT)} {_SPELT_SQL} END) || ' ' || p_brand AS name FROM part)
SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name COLLATE it) AS place FROM n"""


def epithet_nearby(spark: SparkSession, d: str) -> DataFrame:
    """Editions put together from parts: a deity, words of varying length, an epithet, with attributes here and there."""
    k, word = F.col("p_partkey"), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    pick = lambda m, r, text: F.when(k % m == r, F.lit(text)).otherwise(F.lit(""))
    edition = F.concat(
        F.lit('<ab><lb n="1"/>'), pick(11, 3, '<rs type="epithet">alone</rs>'), F.lit('<persName type="divine"'), pick(5, 2, ' nymRef="x"'), F.lit(' key="'), word(1), F.lit('"><name>'), word(1), F.lit("</name>"),
        pick(4, 1, '<rs type="epithet">inner</rs>'), F.lit("</persName>"), F.repeat(F.concat(F.lit(" "), F.col("p_name")), (k % 17).cast("int")), pick(6, 0, '<lb n="2"/>cut-\n<lb n="3"/>x'),
        F.lit("<rs"), pick(7, 4, ' nymRef="y"'), F.lit(' type="epithet"'), pick(9, 5, ' key="z"'), F.lit(">"), word(2), F.lit("</rs>"), pick(3, 1, '<persName type="divine">b</persName>'), F.lit("</ab>"),
    )
    return markup.epithet_issues(dealt(spark, d, "part", "p_partkey").select("p_partkey", edition.alias("edition")), "p_partkey", "edition")


def _pick(m: int, r: int, text: str) -> str:
    text = text.replace("\n", "' || chr(10) || '")
    return f"CASE WHEN p_partkey % {m} = {r} THEN '{text}' ELSE '' END"


_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_DEITY = f"""'<persName type="divine"' || {_pick(5, 2, ' nymRef="x"')} || ' key="' || {_W1} || '"><name>' || {_W1} || '</name>' || {_pick(4, 1, '<rs type="epithet">inner</rs>')} || '</persName>'"""
_EPITHET = f"""'<rs' || {_pick(7, 4, ' nymRef="y"')} || ' type="epithet"' || {_pick(9, 5, ' key="z"')} || '>' || {_W2} || '</rs>'"""
_FIRST, _FILL = f"""'<ab><lb n="1"/>' || {_pick(11, 3, '<rs type="epithet">alone</rs>')}""", "repeat(' ' || p_name, p_partkey % 17) || " + _pick(6, 0, '<lb n="2"/>cut-\n<lb n="3"/>x')
Q["epithet_nearby"] = rf"""WITH e AS (SELECT p_partkey, p_partkey AS k, {_FIRST} AS a, {_DEITY} AS deity, {_FILL} AS fill, {_EPITHET} AS epithet, {_pick(3, 1, '<persName type="divine">b</persName>')} AS after FROM part),
i AS (SELECT *, length(a) AS at_deity, length(a || deity) AS deity_end, length(a || deity || fill) AS at_epithet FROM e),
p AS (
  SELECT p_partkey, length('<ab><lb n="1"/>') AS "at", 'epithet_outside_person' AS problem, '<rs type="epithet">alone</rs>' AS whole FROM i WHERE k % 11 = 3
  UNION ALL SELECT p_partkey, at_epithet, 'epithet_outside_person', epithet FROM i
  UNION ALL SELECT p_partkey, at_epithet, 'nymref_on_epithet', epithet FROM i WHERE k % 7 = 4
  UNION ALL SELECT p_partkey, at_epithet, 'key_on_epithet', epithet FROM i WHERE k % 9 = 5
  UNION ALL SELECT p_partkey, at_deity, 'nymref_on_person', deity FROM i WHERE k % 5 = 2
  UNION ALL SELECT p_partkey, at_deity, 'epithet_nearby', deity FROM i WHERE k % 4 <> 1 AND regexp_matches(substring(fill || epithet, 1, 120), '<rs\s+[^>]*type="epithet"'))
SELECT p_partkey, "at", problem, substring(regexp_replace(whole, '\s+', ' ', 'g'), 1, 90) AS snippet FROM p
UNION ALL SELECT p_partkey, NULL, 'hyphen_at_line_end 1', '<lb n="2"/>cut-' FROM i WHERE k % 6 = 0"""


def edition_faults(spark: SparkSession, d: str) -> DataFrame:
    """Editions of one to four lines put together from parts, with faults here and there."""
    k = F.col("p_partkey")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))

    def line(i):
        h = k * 7 + i * 3
        part = lambda m, r, text: F.when(h % m == r, text).otherwise("")
        return F.concat(
            F.lit('<lb n="'), i + 1, F.lit('"'), part(5, 0, ' break="no"'), F.lit("/>"), word, part(7, 2, " [x]"), part(6, 1, "-"),
            part(3, 0, F.concat(F.lit('<gap quantity="'), h % 4, F.lit('"/>'))), part(3, 1, F.concat(F.lit('<gap unit="'), F.col("p_type"), F.lit('"'), F.when(h % 2 == 1, ' extent="unknown"').otherwise(""), F.lit("/>"))),
            part(8, 3, F.concat(F.lit('<persName type="divine"'), F.when(h % 9 < 4, ' key="" ref=""').otherwise(' key="z"'), F.lit("><name>a</name></persName>"))),
            part(10, 4, F.concat(F.lit('<persName type="ruler" key="Some Theos"><name>b</name>'), F.when(h % 4 < 2, '<rs type="epithet">c</rs>').otherwise('<rs type="epithet"> </rs>'), F.lit("</persName>"))),
            part(11, 6, '<rs type="epithet" key="q">d</rs>'),
        )

    edition = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 4), line), "")
    return markup.edition_issues(markup.tokens(dealt(spark, d, "part", "p_partkey").withColumn("edition", edition), "p_partkey", "edition"), "p_partkey")


Q["edition_faults"] = r"""WITH l AS (SELECT p_partkey, unnest(range(p_partkey % 4 + 1)) AS i FROM part), h AS (SELECT p_partkey, i, p_partkey * 7 + i * 3 AS h, CAST(i + 1 AS INTEGER) AS line FROM l),
f AS (SELECT p_partkey, line, 'first_line_continues' AS rule FROM h WHERE i = 0 AND h % 5 = 0
  UNION ALL SELECT p_partkey, line, 'leiden_residue' FROM h WHERE h % 7 = 2
  UNION ALL SELECT a.p_partkey, a.line, 'hyphen_before_line' FROM h AS a JOIN h AS b ON a.p_partkey = b.p_partkey AND b.i = a.i + 1 WHERE a.h % 6 = 1 AND a.h % 8 <> 3 AND a.h % 10 <> 4 AND a.h % 11 <> 6
  UNION ALL SELECT p_partkey, line, 'gap_of_zero' FROM h WHERE h % 3 = 0 AND h % 4 = 0
  UNION ALL SELECT p_partkey, line, 'unit_unknown' FROM h WHERE h % 3 = 1
  UNION ALL SELECT p_partkey, line, 'gap_without_extent' FROM h WHERE h % 3 = 1 AND h % 2 = 0
  UNION ALL SELECT p_partkey, line, 'empty_attribute' FROM h, range(2) WHERE h % 8 = 3 AND h % 9 < 4
  UNION ALL SELECT p_partkey, line, 'divine_without_key' FROM h WHERE h % 8 = 3 AND h % 9 < 4
  UNION ALL SELECT p_partkey, line, 'epithet_in_key' FROM h WHERE h % 10 = 4 AND h % 4 < 2
  UNION ALL SELECT p_partkey, line, 'key_on_epithet' FROM h WHERE h % 11 = 6
  UNION ALL SELECT p_partkey, line, CASE WHEN (SELECT count(*) FROM h AS b WHERE b.p_partkey = a.p_partkey AND b.i <= a.i AND b.h % 8 = 3) >= 2 THEN 'epithet_after_coordinated' ELSE 'epithet_outside_person' END FROM h AS a WHERE h % 11 = 6)
SELECT p_partkey, line, rule, CASE WHEN rule IN ('leiden_residue', 'hyphen_before_line', 'divine_without_key', 'epithet_in_key', 'epithet_after_coordinated') THEN 'warning' ELSE 'error' END AS severity FROM f"""


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of conversations after changes of status, of which a conversation has several."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("e"), F.col("turn").alias("created"), F.length("text").alias("n"))
    status = F.when(F.col("n") % 2 == 0, "open").otherwise("resolved")
    notes = c.select("e", status.alias("status"), "created", F.when(F.col("n") % 2 == 1, F.col("created") + 1).alias("resolved"))
    changes = c.where("e % 3 <> 0 AND n % 5 < 3").select("e", F.when(F.col("n") % 3 == 0, "open").otherwise("resolved").alias("status"), (F.col("created") * 10).alias("at"))
    return mutate.status_set(notes, "e", changes)


Q["status_changes"] = """WITH c AS (SELECT conv_id AS e, turn AS created, length(text) AS n FROM conversations),
x AS (SELECT e, CASE WHEN n % 3 = 0 THEN 'open' ELSE 'resolved' END AS status, created * 10 AS at_ FROM c WHERE e % 3 <> 0 AND n % 5 < 3), l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY e ORDER BY at_ DESC, status DESC) = 1)
SELECT c.e, coalesce(l.status, CASE WHEN n % 2 = 0 THEN 'open' ELSE 'resolved' END) AS status, created, CASE WHEN l.e IS NULL THEN CASE WHEN n % 2 = 1 THEN created + 1 END WHEN l.status = 'resolved' THEN at_ END AS resolved FROM c LEFT JOIN l ON c.e = l.e"""


def import_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Parts as an import in which ids, titles and other fields are missing here and there."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, 0).otherwise(k + 100000).cast("long").alias("id"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "").alias("titolo"), F.when(k % 5 > 1, F.col("p_brand")).alias("tipo"),
        F.when(k % 2 == 0, F.array(F.lit("Iscrizione GRECA"), F.col("p_type"))).alias("textTypes"), F.when(k % 6 == 0, F.col("p_size").cast("string")).when(k % 6 == 1, "x").alias("data_inizio"), F.array("p_type").alias("onomastica"), k.alias("ord"),
    )
    made = imports.defaulted(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "ord")
    return made.select("id", "entryId", "titolo", "tipo", "dim_unita", F.array_join("textTypes", ",").alias("kinds"), "data_inizio", "iscrizione", F.size("phi").cast("long").alias("n_phi"), F.array_join("onomastica", ",").alias("names"))


Q["import_defaults"] = """WITH r AS (SELECT p_partkey AS k, *, CASE WHEN p_partkey % 4 IN (1, 2) THEN NULL ELSE p_partkey + 100000 END AS own, row_number() OVER (ORDER BY p_partkey) AS place FROM part),
n AS (SELECT *, coalesce(own, (SELECT max(s_suppkey) FROM supplier) + count(*) FILTER (WHERE own IS NULL) OVER (ORDER BY k)) AS id FROM r)
SELECT CAST(id AS BIGINT) AS id, 'gen-import-' || place AS "entryId", CASE WHEN k % 3 = 0 THEN p_name ELSE 'Scheda #' || coalesce(own, place) END AS titolo, CASE WHEN k % 5 > 1 THEN p_brand ELSE '' END AS tipo, 'metre' AS dim_unita,
  CASE WHEN k % 2 = 0 THEN p_type ELSE '' END AS kinds, CASE WHEN k % 6 = 0 THEN CAST(p_size AS DOUBLE) END AS data_inizio, false AS iscrizione, CAST(0 AS BIGINT) AS n_phi, p_type AS names FROM n"""


def tag_search(spark: SparkSession, d: str) -> DataFrame:
    """What each #word of the notes finds among documents, all words at once."""
    notes = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("nota"), F.concat("text", F.lit(" #"), F.split_part("text", F.lit(" "), F.lit(2)), F.lit(" #src1")).alias("text"))
    found = mutate.tag_hits(notes, _index(spark, d), text="text", key="nota")
    return found.select("tag", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "n_words")


Q["tag_search"] = rf"""WITH f AS ({_FIELDS_SQL}), a AS (SELECT id, field, boost, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS terms FROM f),
p AS (SELECT id, field, boost, len(terms) AS size, unnest(terms) AS term FROM a), i AS (SELECT id, field, boost, size, term, count(*) AS tf FROM p GROUP BY ALL),
m AS (SELECT field, avg(size) AS mean FROM (SELECT DISTINCT id, field, size FROM i) GROUP BY 1), n AS (SELECT count(DISTINCT id) AS total FROM i), df AS (SELECT field, term, count(*) AS df FROM i GROUP BY 1, 2),
g AS (SELECT DISTINCT unnest(regexp_extract_all(text || ' #' || split_part(text, ' ', 2) || ' #src1', '#[A-Za-z0-9_]+')) AS tag FROM conversations),
q AS (SELECT DISTINCT tag, unnest(regexp_extract_all(lower(tag), '[\p{{L}}\p{{N}}]+')) AS term FROM g)
SELECT tag, id AS doc_id, round(sum(boost * ln(1 + (total - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * size / mean)))), 4) AS score, count(DISTINCT term) AS n_words
FROM q JOIN i USING (term) JOIN df USING (field, term) JOIN m USING (field), n GROUP BY 1, 2"""


def save_gate(spark: SparkSession, d: str) -> DataFrame:
    """Parts as XML, with faults in a line of their own: which parse, and the line of the first fault."""
    k = F.col("p_partkey")
    faults = ["<b></c>", "<b c=d/>", "&nope;", '<b c="1" c="2"/>', "<b", "a & b", "<b/>", "x", "&lt;", "<!-- c -->"]
    fault = F.element_at(F.array(*map(F.lit, faults)), (k % len(faults) + 1).cast("int"))
    xml = F.concat(F.lit("<a>"), F.repeat(F.lit("\n"), (k % 7).cast("int")), F.col("p_name"), F.lit(" "), fault, F.lit("\n</a>"))
    return corpus.well_formed(table(spark, d, "part").select("p_partkey", xml.alias("xml")), "p_partkey", "xml").select("p_partkey", F.col("reason").isNull().alias("ok"), "line")


Q["save_gate"] = "SELECT p_partkey, p_partkey % 10 >= 6 AS ok, CASE WHEN p_partkey % 10 < 6 THEN 1 + p_partkey % 7 + CASE WHEN p_partkey % 10 = 4 THEN 1 ELSE 0 END END AS line FROM part"

QUERIES = [search_updated, diff_rows, two_sided_lanes, collated_names, epithet_nearby, edition_faults, status_changes, import_defaults, tag_search, save_gate]
