"""Queries of set-valued statistics, merges and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import mutate, rules, statistics
from corpusloom.plans.views import ITEMS, VERSIONS, items, places, table, versions, spread

Q: dict[str, str] = {}
WORD = r"[^\x20\x09-\x0D]+"


def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.entity_stats(items(spark, d), "marca", "tipo", "regione")


Q["entity_stats"] = f"""WITH {ITEMS}, p AS (SELECT marca, tipo, count(*) AS k FROM items GROUP BY 1, 2),
l AS (SELECT marca, string_agg(tipo || ':' || k, '|' ORDER BY k DESC, tipo) AS parts FROM p GROUP BY 1)
SELECT marca AS value, count(*) AS n, count(DISTINCT regione) AS n_regions, any_value(parts) AS parts FROM items JOIN l USING (marca) GROUP BY 1"""


def name_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.value_stats(items(spark, d), "nome", "regione")


Q["name_stats"] = f"WITH {ITEMS} SELECT nome AS value, count(*) AS n, count(DISTINCT regione) AS n_regions FROM items GROUP BY 1"


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    each = items(spark, d)
    axis = lambda c: each.select("record", F.col(c).alias("value"))
    total = table(spark, d, "orders").count()
    return statistics.cooccurrence(axis("marca"), axis("citta"), total).select("row_value", "col_value", "n", "row_n", "col_n")


PAIRS = f"""{ITEMS}, r AS (SELECT DISTINCT record, marca AS value FROM items), c AS (SELECT DISTINCT record, citta AS value FROM items),
p AS (SELECT r.value AS row_value, c.value AS col_value, count(*) AS n FROM r JOIN c USING (record) GROUP BY 1, 2),
m AS (SELECT p.*, (SELECT count(*) FROM r WHERE r.value = row_value) AS row_n, (SELECT count(*) FROM c WHERE c.value = col_value) AS col_n, (SELECT count(*) FROM orders) AS total FROM p)"""
Q["cooccurrence"] = f"WITH {PAIRS} SELECT row_value, col_value, n, row_n, col_n FROM m"


def pmi(spark: SparkSession, d: str) -> DataFrame:
    each = items(spark, d)
    axis = lambda c: each.select("record", F.col(c).alias("value"))
    return statistics.cooccurrence(axis("marca"), axis("citta"), table(spark, d, "orders").count()).select("row_value", "col_value", F.round("pmi", 4).alias("pmi"), "reading")


Q["pmi"] = f"""WITH {PAIRS}, v AS (SELECT *, log2(n * total / (row_n * col_n)) AS x FROM m)
SELECT row_value, col_value, round(x, 4) AS pmi, CASE WHEN n < 3 THEN 'low' WHEN round(x, 6) >= 1 THEN 'stronger' WHEN round(x, 6) <= -1 THEN 'weaker' ELSE 'expected' END AS reading FROM v"""


def cooccurrence_assoc(spark: SparkSession, d: str) -> DataFrame:
    """The pairs come from what a record associates, not from the product of its lists."""
    assoc = items(spark, d).groupBy("record").agg(F.collect_set(F.struct("marca", "tipo")).alias("divinitaEpiteti"))
    pairs = assoc.select("record", F.explode("divinitaEpiteti").alias("x")).groupBy(F.col("x.marca").alias("row_value"), F.col("x.tipo").alias("col_value"))
    return pairs.agg(F.count("*").alias("n"))


Q["cooccurrence_assoc"] = f"WITH {ITEMS} SELECT marca AS row_value, tipo AS col_value, count(DISTINCT record) AS n FROM items GROUP BY 1, 2"


def variant_conflicts(spark: SparkSession, d: str) -> DataFrame:
    words = spread(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    return statistics.variant_conflicts(words, "word", text.fold_spaced(F.col("word")))


Q["variant_conflicts"] = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS variant FROM documents),
v AS (SELECT lower(replace(strip_accents(variant), 'ς', 'σ')) AS key, variant, count(*) AS k FROM w GROUP BY 1, 2)
SELECT key, count(*) AS n_variants, string_agg(variant, '|' ORDER BY k DESC, variant) AS variants, CAST(sum(k) AS BIGINT) AS n_uses FROM v WHERE key <> '' GROUP BY 1 HAVING count(*) > 1"""


def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "id")
    return statistics.missing(docs, no_label=F.col("quality").isNull(), short=F.col("n_chars") < 200, escaped=F.contains("text", F.lit("&lt;")), one_line=~F.contains("text", F.lit("\n")), no_lang=F.coalesce("lang", F.lit("")) == "")


Q["missing_fields"] = """WITH j AS (SELECT d.doc_id AS id, d.*, quality FROM documents AS d LEFT JOIN labels USING (doc_id)),
x AS (SELECT id, unnest([{'rule': 'no_label', 'hit': quality IS NULL}, {'rule': 'short', 'hit': n_chars < 200}, {'rule': 'escaped', 'hit': contains(text, '&lt;')}, {'rule': 'one_line', 'hit': NOT contains(text, chr(10))}, {'rule': 'no_lang', 'hit': coalesce(lang, '') = ''}]) AS x FROM j)
SELECT x.rule AS rule, count(*) FILTER (WHERE x.hit) AS n, min(id) FILTER (WHERE x.hit) AS first_id FROM x GROUP BY 1"""


def draft_match(spark: SparkSession, d: str) -> DataFrame:
    return mutate.draft_matches(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


Q["draft_match"] = "SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels) AS has_match FROM documents"


def mirror_sync(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return mutate.mirror_deletes(table(spark, d, "documents"), labels.where("quality = 1"), labels.where("toxic = 1"), confirmed=True, name="doc_id")


Q["mirror_sync"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)"


def merge_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return mutate.merge_overwrite(*versions(spark, d))


Q["merge_overwrite"] = f"WITH {VERSIONS} SELECT * FROM incoming"


def merge_append(spark: SparkSession, d: str) -> DataFrame:
    return mutate.merge_append(*versions(spark, d), "chiave", "ord")


Q["merge_append"] = f"WITH {VERSIONS} SELECT * FROM existing UNION ALL SELECT chiave || '-copy-' || ord, ord, misura, file FROM incoming"


def merge_skip(spark: SparkSession, d: str) -> DataFrame:
    return mutate.merge_skip(*versions(spark, d), "chiave", "ord")


Q["merge_skip"] = f"""WITH {VERSIONS} SELECT * FROM existing UNION ALL SELECT chiave, ord, misura, file FROM (
  SELECT *, row_number() OVER (PARTITION BY chiave ORDER BY ord) AS nth FROM incoming WHERE chiave NOT IN (SELECT chiave FROM existing)) WHERE nth = 1"""


def merge_replace(spark: SparkSession, d: str) -> DataFrame:
    return mutate.merge_replace(*versions(spark, d), "chiave", "ord", keep=("file",))


Q["merge_replace"] = f"""WITH {VERSIONS}, n AS (SELECT chiave, max(ord) AS ord, arg_max(misura, ord) AS misura FROM incoming GROUP BY 1)
SELECT e.chiave, coalesce(n.ord, e.ord) AS ord, coalesce(n.misura, e.misura) AS misura, e.file FROM existing AS e LEFT JOIN n USING (chiave)
UNION ALL SELECT * FROM incoming WHERE chiave NOT IN (SELECT chiave FROM existing)"""


def _keyless(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Versions of which some keys are null and some empty, on both sides."""
    key = F.when(F.col("ord") % 7 == 0, F.lit(None)).when(F.col("ord") % 7 == 1, F.lit("")).otherwise(F.col("chiave"))
    old, new = versions(spark, d)
    return old.withColumn("chiave", key), new.withColumn("chiave", key)


_KEYLESS = "SELECT CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 7 = 1 THEN '' ELSE chiave END AS chiave, ord, misura, file FROM"
KEYLESS = f"{VERSIONS}, old AS ({_KEYLESS} existing), new AS ({_KEYLESS} incoming), held AS (SELECT DISTINCT chiave FROM old WHERE chiave <> '')"


def merge_skip_keyless(spark: SparkSession, d: str) -> DataFrame:
    return mutate.merge_skip(*_keyless(spark, d), "chiave", "ord")


Q["merge_skip_keyless"] = f"""WITH {KEYLESS} SELECT * FROM old UNION ALL SELECT * FROM new WHERE coalesce(chiave, '') = '' UNION ALL SELECT chiave, ord, misura, file FROM (
  SELECT *, row_number() OVER (PARTITION BY chiave ORDER BY ord) AS nth FROM new WHERE chiave <> '' AND chiave NOT IN (SELECT chiave FROM held)) WHERE nth = 1"""


def merge_replace_keyless(spark: SparkSession, d: str) -> DataFrame:
    return mutate.merge_replace(*_keyless(spark, d), "chiave", "ord", keep=("file",))


Q["merge_replace_keyless"] = f"""WITH {KEYLESS}, n AS (SELECT chiave, max(ord) AS ord, arg_max(misura, ord) AS misura FROM new WHERE chiave <> '' GROUP BY 1)
SELECT e.chiave, coalesce(n.ord, e.ord) AS ord, coalesce(n.misura, e.misura) AS misura, e.file FROM old AS e LEFT JOIN n ON e.chiave = n.chiave
UNION ALL SELECT * FROM new WHERE coalesce(chiave, '') = '' OR chiave NOT IN (SELECT chiave FROM held)"""


def upsert(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    old = docs.select("doc_id", F.lit(None).cast("int").alias("quality"), F.col("lang").alias("stato"))
    new = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.when(F.col("toxic") == 1, "bloccato").alias("stato"))
    return mutate.upsert(old, new, "doc_id")


Q["upsert"] = "SELECT d.doc_id, CAST(quality AS INT) AS quality, CASE WHEN toxic = 1 THEN 'bloccato' ELSE lang END AS stato FROM documents AS d LEFT JOIN labels USING (doc_id)"


def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.when(F.col("p_size") < 5, F.lit(0).cast("long")).otherwise(F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("ord"), "p_name")
    return mutate.assign_ids(parts, "ord")


Q["assign_ids"] = """WITH x AS (SELECT CASE WHEN p_size < 5 THEN 0 ELSE p_partkey END AS id, p_partkey AS ord, p_name FROM part)
SELECT CASE WHEN id > 0 THEN id ELSE (SELECT max(id) FROM x) + row_number() OVER (PARTITION BY id > 0 ORDER BY ord) END AS id, ord, p_name FROM x"""


def stale_check(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("now"))
    base = F.when(F.col("quality") == 1, F.col("now")).when(F.col("toxic") == 1, F.lit("older"))
    saves = table(spark, d, "labels").join(current, "doc_id", "left").select(F.when(F.col("toxic") == 1, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), base.alias("base"))
    return mutate.staleness(current, saves, "doc_id", "now", "base")


Q["stale_check"] = """WITH s AS (SELECT CASE WHEN toxic = 1 THEN -l.doc_id ELSE l.doc_id END AS doc_id, CASE WHEN quality = 1 THEN sha256(text) WHEN toxic = 1 THEN 'older' END AS base FROM labels AS l LEFT JOIN documents AS d ON l.doc_id = d.doc_id)
SELECT s.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN base IS NULL THEN 'unknown' WHEN base <> sha256(text) THEN 'stale' ELSE 'ok' END AS status FROM s LEFT JOIN documents AS d ON s.doc_id = d.doc_id"""


def section_diff(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    after = p.withColumn("p_size", F.when(F.col("p_size") > 40, 40).otherwise(F.col("p_size"))).withColumn("p_type", F.when(F.col("p_brand") == "Brand#3", None).otherwise(F.col("p_type")))
    return mutate.section_diff(p, after, "p_partkey", {"identity": ("p_name", "p_brand"), "measure": ("p_size", "p_retailprice"), "kind": ("p_type",)})


Q["section_diff"] = """SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'measure' END, CASE WHEN p_brand = 'Brand#3' AND p_type IS NOT NULL THEN 'kind' END) AS changed
FROM part WHERE p_size > 40 OR (p_brand = 'Brand#3' AND p_type IS NOT NULL)"""



def _violation():
    return rules.first_violation(("no id", F.col("doc_id").isNull() | (F.col("doc_id") < 0)), rules.longer("text", 5000), ("no text", F.trim("text") == ""), rules.longer("source", 4), ("too short", F.col("n_chars") < 100))


def shape_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.split_valid(table(spark, d, "documents"), _violation())[1].select("doc_id", "violation")


VIOLATION = "CASE WHEN doc_id IS NULL OR doc_id < 0 THEN 'no id' WHEN length(text) > 5000 THEN 'text longer than 5000' WHEN trim(text) = '' THEN 'no text' WHEN length(source) > 4 THEN 'source longer than 4' WHEN n_chars < 100 THEN 'too short' END"
Q["shape_rules"] = f"SELECT doc_id, {VIOLATION} AS violation FROM documents WHERE {VIOLATION} IS NOT NULL"


def record_shape(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records, of which some are too long or hold too much in one field each."""
    p, n = table(spark, d, "part"), F.col("p_partkey") % 23
    text = lambda k, most: F.when(n == k, F.repeat(F.lit("x"), most + 1)).otherwise(F.repeat(F.lit("x"), most))
    many = lambda k, most: F.array_repeat(F.lit("v"), F.when(n == k, most + 1).otherwise(most).cast("int"))
    trait = F.struct(F.lit("t").alias("type"), F.lit("k").alias("key"))
    figure = F.struct(F.array_repeat(trait, F.when(n == 18, 51).otherwise(50).cast("int")).alias("traits"), text(19, 50).alias("place"))
    ico = F.struct(text(15, 200).alias("function"), text(16, 10_000).alias("note"), F.array_repeat(figure, F.when(n == 17, 51).otherwise(1).cast("int")).alias("figures"))
    rows = p.select(
        "p_partkey", F.when(n == 20, F.lit(None).cast("long")).when(n == 21, F.lit(-1).cast("long")).otherwise(F.col("p_partkey")).alias("id"), text(0, 200).alias("citta"), F.when(n == 1, F.repeat(F.lit("é"), 201)).alias("regione"), text(2, 200).alias("tipo"), text(3, 200).alias("materiale"), text(4, 50_000).alias("testo"),
        text(5, 10_000).alias("note_interne"), F.lit(None).cast("string").alias("note_interne_rawXml"), many(6, 50).alias("epiteti"), many(7, 50).alias("divinita"), many(8, 50).alias("onomastica"), many(9, 50).alias("textTypes"), many(10, 50).alias("imperatori"),
        many(11, 100).alias("persone"), many(12, 50).alias("traduzioni"), many(13, 50).alias("bibliografia"), many(14, 100).alias("revisions"), F.when(n != 22, ico).alias("iconografia"),
    )
    return rows.select("p_partkey", rules.record_shape().alias("violation")).where("violation IS NOT NULL")


_SHAPES = ["citta longer than 200", "regione longer than 200", "tipo longer than 200", "materiale longer than 200", "testo longer than 50000", "note_interne longer than 10000", "epiteti more than 50", "divinita more than 50", "onomastica more than 50", "textTypes more than 50",
    "imperatori more than 50", "persone more than 100", "traduzioni more than 50", "bibliografia more than 50", "revisions more than 100", "iconografia.function longer than 200", "iconografia.note longer than 10000", "iconografia.figures more than 50", "traits more than 50", "place longer than 50", "id is no number from 0", "id is no number from 0"]
Q["record_shape"] = "SELECT p_partkey, violation FROM part JOIN (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_SHAPES)) + ") AS v(k, violation) ON p_partkey % 23 = k"


def import_validate(spark: SparkSession, d: str) -> DataFrame:
    return rules.tally(table(spark, d, "documents"), _violation())


Q["import_validate"] = f"SELECT coalesce({VIOLATION}, 'imported') AS outcome, count(*) AS n FROM documents GROUP BY 1"


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("stato", F.when(F.contains("text", F.lit("\n")), "open").otherwise("resolved"))
    rows = rows.withColumn("etichetta", F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("turn").cast("string"))).otherwise(""))
    return mutate.ledger(rows, "conv_id", label="etichetta", status="stato", created="turn", resolved="turn", note="text")


def ledger_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)


LEDGER = """ledger AS (SELECT conv_id, CASE WHEN bool_or(contains(text, chr(10))) THEN 'open' ELSE 'resolved' END AS status, min(turn) AS created,
  CASE WHEN NOT bool_or(contains(text, chr(10))) THEN max(turn) END AS resolved, coalesce('u' || max(turn) FILTER (WHERE role = 'user'), CAST(conv_id AS VARCHAR)) AS label,
  count(*) AS n_notes, string_agg(text, chr(10) ORDER BY turn, text) AS notes FROM conversations GROUP BY 1)"""
Q["ledger_normalize"] = f"WITH {LEDGER} SELECT * FROM ledger"


def ledger_open(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_notes").alias("n_notes"))


Q["ledger_open"] = f"WITH {LEDGER} SELECT status, count(*) AS n, CAST(sum(n_notes) AS BIGINT) AS n_notes FROM ledger GROUP BY 1"


def note_crossref(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("nota"), F.concat("text", F.lit(" @"), (F.col("conv_id") * 3).cast("string"), F.lit(" @"), F.col("turn").cast("string")).alias("text"))
    return mutate.cross_references(notes, table(spark, d, "documents").select(F.col("doc_id").alias("id")), text="text", key="nota")


Q["note_crossref"] = r"""WITH n AS (SELECT conv_id || '-' || turn AS nota, text || ' @' || (conv_id * 3) || ' @' || turn AS text FROM conversations),
r AS (SELECT nota, CAST(unnest(list_distinct(regexp_extract_all(text, '@(\d{1,18})', 1))) AS BIGINT) AS ref FROM n)
SELECT nota, ref, ref IN (SELECT doc_id FROM documents) AS known FROM r"""


def known_authors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names over two sources."""
    return table(spark, d, "customer").select(F.col("c_name").alias("author")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("author"))).distinct()


Q["known_authors"] = "SELECT c_name AS author FROM customer UNION SELECT s_name FROM supplier"


def map_bounds(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.sites import bounds

    return bounds(places(spark, d).select(F.col("n_nationkey").cast("double").alias("lat"), F.length("citta").cast("double").alias("lng")))


Q["map_bounds"] = "SELECT CAST(min(n_nationkey) AS DOUBLE) AS south, CAST(max(n_nationkey) AS DOUBLE) AS north, CAST(min(length(n_name)) AS DOUBLE) AS west, CAST(max(length(n_name)) AS DOUBLE) AS east, count(*) AS n FROM nation"

QUERIES = [
    entity_stats, name_stats, cooccurrence, pmi, cooccurrence_assoc, variant_conflicts, missing_fields, draft_match, mirror_sync, merge_overwrite, merge_append, merge_skip, merge_replace, merge_skip_keyless, merge_replace_keyless, upsert,
    assign_ids, stale_check, section_diff, shape_rules, record_shape, import_validate, ledger_normalize, ledger_open, note_crossref, known_authors, map_bounds,
]
