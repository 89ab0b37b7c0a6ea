"""Queries of what is derived from records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import catalogue, derive, mutate
from corpusloom.plans.views import ITEMS, RECORDS, items, records, table

Q: dict[str, str] = {}


def drill_down(spark: SparkSession, d: str) -> DataFrame:
    lists = items(spark, d).groupBy("record").agg(F.collect_set("marca").alias("divinita"), F.collect_set("tipo").alias("epiteti"))
    return derive.drill_down(lists, divinita="Brand#7", epiteti="ECONOMY").select("record", F.size("divinita").cast("long").alias("n"))


Q["drill_down"] = f"""WITH {ITEMS} SELECT record, count(DISTINCT marca) AS n FROM items
WHERE record IN (SELECT record FROM items WHERE marca = 'Brand#7') AND record IN (SELECT record FROM items WHERE tipo = 'ECONOMY') GROUP BY 1"""


def suggested_function(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    kinds = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("id"), "p_type", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"))
    return derive.suggested_function(kinds, "id", "p_type", "place", {"economy": "votive", "promo": "honorary"}, {"and": "funerary", "ARGE": "decree"})


_FUNCTION = "CASE WHEN lower(p_type) = 'economy' THEN 'votive' WHEN lower(p_type) = 'promo' THEN 'honorary' WHEN contains(lower(p_type), 'and') THEN 'funerary' WHEN contains(lower(p_type), 'arge') THEN 'decree' END"
Q["suggested_function"] = f"""WITH k AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey AS place, {_FUNCTION} AS function FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT id, arg_min(function, place) AS function FROM k WHERE function IS NOT NULL GROUP BY 1"""


def guessed_names(spark: SparkSession, d: str) -> DataFrame:
    word = F.split_part(F.col("text"), F.lit(" "), F.lit(1))
    found = table(spark, d, "documents").select("doc_id", derive.guessed_name(word, {"ele": "Elea", "cion": "Cion", "th": "Theos"}).alias("name"))
    return found.where("name IS NOT NULL")


Q["guessed_names"] = """WITH w AS (SELECT doc_id, lower(replace(strip_accents(split_part(text, ' ', 1)), 'ς', 'σ')) AS w FROM documents),
n AS (SELECT doc_id, CASE WHEN starts_with(w, 'ele') THEN 'Elea' WHEN starts_with(w, 'cion') THEN 'Cion' WHEN starts_with(w, 'th') THEN 'Theos' END AS name FROM w) SELECT * FROM n WHERE name IS NOT NULL"""


def carried_over(spark: SparkSession, d: str) -> DataFrame:
    derived = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "fr", F.col("source")).alias("nota"), F.lit(None).cast("bigint").alias("peso"))
    previous = table(spark, d, "labels").select("doc_id", F.lit("prima").alias("nota"), F.col("quality").cast("bigint").alias("peso"))
    return derive.carried_over(derived, previous, ["doc_id"], ["nota", "peso"])


Q["carried_over"] = "SELECT d.doc_id, coalesce(CASE WHEN lang = 'fr' THEN source END, CASE WHEN l.doc_id IS NOT NULL THEN 'prima' END) AS nota, CAST(quality AS BIGINT) AS peso FROM documents AS d LEFT JOIN labels AS l USING (doc_id)"


def section_states(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    after = r.withColumn("materiale", F.when(F.col("materiale") == "BUILDING", "stone").otherwise(F.col("materiale")))
    sections = {"support": ("materiale", "tipo"), "dates": ("data_fine",), "place": ("regione", "citta")}
    return derive.section_states(r, "id", mutate.section_diff(r, after, "id", sections), sections).groupBy("section", "state").agg(F.count("*").alias("n"))


Q["section_states"] = f"""WITH {RECORDS}, s AS (SELECT 'support' AS section, CASE WHEN materiale = 'BUILDING' THEN 'dirty' ELSE 'present' END AS state FROM records
UNION ALL SELECT 'dates', CASE WHEN data_fine IS NULL THEN 'absent' ELSE 'present' END FROM records UNION ALL SELECT 'place', 'present' FROM records) SELECT section, state, count(*) AS n FROM s GROUP BY 1, 2"""


def selection(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    hits = catalogue.CatalogueQuery(materiale="MACHINERY").apply(r)
    return derive.selected(r, hits, inverse=True).groupBy("materiale").agg(F.count("*").alias("n"))


Q["selection"] = f"WITH {RECORDS} SELECT materiale, count(*) AS n FROM records WHERE id NOT IN (SELECT id FROM records WHERE materiale = 'MACHINERY' AND (data_inizio = 0 OR data_fine IS NULL OR data_fine = 0 OR (data_inizio >= -500 AND data_fine <= 500))) GROUP BY 1"


def base64_texts(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "benchmark").select("item_id", text.to_base64(F.col("text")).alias("coded"))
    return coded.withColumn("again", text.from_base64(F.col("coded")))


Q["base64_texts"] = "SELECT item_id, base64(encode(text)) AS coded, text AS again FROM benchmark"


def bibliography_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lower(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))), (F.col("p_size") + 1950).cast("string"), F.when(F.col("p_size") > 25, "b").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.bibliography_key(key).alias("shown"))


Q["bibliography_keys"] = """WITH k AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, (p_size + 1950) || CASE WHEN p_size > 25 THEN 'b' ELSE '' END AS y FROM part)
SELECT p_partkey, CASE WHEN length(a) <= 3 THEN upper(a) ELSE upper(a[1]) || a[2:] END || ' ' || y AS shown FROM k"""

QUERIES = [drill_down, suggested_function, guessed_names, carried_over, section_states, selection, base64_texts, bibliography_keys]
