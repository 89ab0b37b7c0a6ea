"""Queries of the catalogue, the timeline and the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import catalogue, mutate, sites, statistics, timeline
from corpusloom.plans.views import RECORDS, places, records, table

UNSET = "(data_inizio IS NULL OR data_inizio = 0 OR data_fine IS NULL OR data_fine = 0)"
Q: dict[str, str] = {}


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return statistics.summary(records(spark, d))


Q["corpus_summary"] = f"WITH {RECORDS} SELECT count(*) AS n_records, count(DISTINCT regione) AS n_regions, count(DISTINCT citta) AS n_cities, min(data_inizio) AS first_year, max(data_fine) AS last_year FROM records"


def catalogue_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.CatalogueQuery(regione="EUROPE", materiale="BUILDING", dates=(-500, 500)).apply(records(spark, d))


Q["catalogue_filter"] = f"WITH {RECORDS} SELECT * FROM records WHERE regione = 'EUROPE' AND materiale = 'BUILDING' AND ({UNSET} OR (data_inizio >= -500 AND data_fine <= 500))"


def date_contains(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(catalogue.date_contained(F.col("data_inizio"), F.col("data_fine"), -300, 300)).select("id", "data_inizio", "data_fine")


Q["date_contains"] = f"WITH {RECORDS} SELECT id, data_inizio, data_fine FROM records WHERE {UNSET} OR (data_inizio >= -300 AND data_fine <= 300)"


def date_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(catalogue.date_overlapping(F.col("data_inizio"), F.col("data_fine"), -300, 300)).select("id", "data_inizio", "data_fine")


Q["date_overlaps"] = f"""WITH {RECORDS} SELECT id, data_inizio, data_fine FROM records
WHERE coalesce(coalesce(data_inizio, data_fine) <= 300 AND coalesce(data_fine, data_inizio) >= -300, true)"""


def catalogue_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).withColumn("luogo", F.concat_ws(" ", "regione", "citta"))
    return catalogue.positions(rows, F.col("luogo"), F.desc("data_inizio"), "id").select("id", "luogo", "data_inizio", "position")


Q["catalogue_sort"] = f"""WITH {RECORDS} SELECT id, regione || ' ' || citta AS luogo, data_inizio,
  row_number() OVER (ORDER BY regione || ' ' || citta, data_inizio DESC, id) AS position FROM records"""


def paginate(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.page(records(spark, d), 3, F.desc("prezzo"), "id").select("id", "citta", "prezzo")


Q["paginate"] = f"WITH {RECORDS} SELECT id, citta, prezzo FROM records ORDER BY prezzo DESC, id LIMIT 25 OFFSET 50"


def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.facets(records(spark, d), "regione", "citta", "tipo", "materiale")


Q["facet_values"] = f"WITH {RECORDS} " + " UNION ".join(f"SELECT '{f}' AS facet, trim({f}) AS value FROM records WHERE trim({f}) <> ''" for f in ("regione", "citta", "tipo", "materiale"))


def nested_exists(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    nested = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("traits"))
    found = nested.where(F.exists("traits", lambda t: (t["l_returnflag"] == "R") & (t["l_quantity"] > 45)))
    return found.select(F.col("l_orderkey").alias("id"), F.size("traits").cast("long").alias("n_traits"))


Q["nested_exists"] = """SELECT l_orderkey AS id, count(*) AS n_traits FROM lineitem AS a
WHERE EXISTS (SELECT 1 FROM lineitem AS b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R' AND b.l_quantity > 45) GROUP BY 1"""


def vocab_lookup(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.search import vocabulary_lookup

    return vocabulary_lookup(table(spark, d, "part"), "p_name", "RÍN")


Q["vocab_lookup"] = "SELECT DISTINCT p_name AS label FROM part WHERE contains(lower(strip_accents(p_name)), 'rin') ORDER BY 1 LIMIT 40"


def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    return timeline.buckets(records(spark, d), width=timeline.bucket_width(9))


Q["time_buckets"] = f"WITH {RECORDS} SELECT CAST(floor(data_inizio / 10.0 + 0.5) * 10 AS BIGINT) AS bucket, count(*) AS n, min(id) AS first_id FROM records GROUP BY 1"


def century_ticks(spark: SparkSession, d: str) -> DataFrame:
    return timeline.century_ticks(records(spark, d))


Q["century_ticks"] = f"""WITH {RECORDS}, domain AS (SELECT CAST(floor(min(data_inizio) / 100.0) * 100 - 100 AS BIGINT) AS low, CAST(ceil(max(data_fine) / 100.0) * 100 + 100 AS BIGINT) AS high FROM records)
SELECT unnest(range(low, high + 1, 100)) AS tick FROM domain"""


def era_label(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", text.range_label(F.col("data_inizio"), F.col("data_fine")).alias("label"))


Q["era_label"] = f"""WITH {RECORDS}, l AS (SELECT *, CASE WHEN data_inizio <> 0 THEN abs(data_inizio) || CASE WHEN data_inizio < 0 THEN ' a.C.' ELSE ' d.C.' END END AS a,
  CASE WHEN data_fine <> 0 THEN abs(data_fine) || CASE WHEN data_fine < 0 THEN ' a.C.' ELSE ' d.C.' END END AS b FROM records)
SELECT id, CASE WHEN data_inizio = data_fine AND a IS NOT NULL THEN a WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ' - ' || b ELSE coalesce(a, b, '-') END AS label FROM l"""


def roman_century(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).where("data_inizio <> 0").withColumn("c", text.century(F.col("data_inizio")))
    return rows.groupBy(text.roman(F.col("c")).alias("century")).agg(F.count("*").alias("n"))


Q["roman_century"] = f"""WITH {RECORDS} SELECT ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][CAST(ceil(abs(data_inizio) / 100.0) AS INT)] AS century, count(*) AS n
FROM records WHERE data_inizio <> 0 GROUP BY 1"""


def lane_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).where(F.col("data_fine").isNotNull() & (F.col("data_inizio") != 0))
    cluster = F.concat_ws("/", "citta", "materiale", timeline.bucket(F.col("data_inizio"), 60).cast("string"))
    return timeline.lanes(rows.select("id", cluster.alias("cluster"), F.col("data_inizio").alias("low"), F.col("data_fine").alias("high")), "cluster")


Q["lane_pack"] = f"""WITH RECURSIVE {RECORDS}, c AS (SELECT id, citta || '/' || materiale || '/' || CAST(CAST(floor(data_inizio / 60.0 + 0.5) * 60 AS BIGINT) AS VARCHAR) AS cluster, data_inizio AS low, data_fine AS high FROM records WHERE data_fine IS NOT NULL AND data_inizio <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY low, id, high) AS k FROM c),
r AS (SELECT cluster, k, id, 0 AS lane, [high] AS ends FROM o WHERE k = 1
  UNION ALL SELECT cluster, k, id, lane, CASE WHEN lane < len(ends) THEN list_transform(ends, lambda e, i: CASE WHEN i = lane + 1 THEN high ELSE e END) ELSE list_append(ends, high) END
  FROM (SELECT o.cluster, o.k, o.id, o.high, r.ends, coalesce(list_position(list_transform(r.ends, lambda e: e < o.low), true) - 1, len(r.ends)) AS lane FROM r JOIN o ON o.cluster = r.cluster AND o.k = r.k + 1))
SELECT cluster, id, CAST(lane AS INT) AS lane FROM r"""


def site_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = sites.with_places(table(spark, d, "customer").withColumnRenamed("c_nationkey", "uri"), places(spark, d).withColumnRenamed("n_nationkey", "uri"))
    return sites.rollup(c, "citta", F.col("c_acctbal") > 0, "c_mktsegment", "c_custkey")


Q["site_rollup"] = """SELECT n_name AS place, count(*) AS n_total, count(*) FILTER (WHERE c_acctbal > 0) AS n_active, arg_min(c_mktsegment, c_custkey) AS first_kind
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


def site_density(spark: SparkSession, d: str) -> DataFrame:
    return sites.density(site_rollup(spark, d), low=(0, 0, 0), high=(255, 128, 64))


Q["site_density"] = """WITH s AS (SELECT n_name AS place, count(*) FILTER (WHERE c_acctbal > 0) AS n_active FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
m AS (SELECT greatest(max(n_active), 1) AS most FROM s),
t AS (SELECT place, n_active, most, sqrt(n_active / CAST(most AS DOUBLE)) AS share FROM s, m)
SELECT place, n_active, '#' || lpad(lower(hex(CAST(floor(255 * share + 0.5) AS BIGINT))), 2, '0') || lpad(lower(hex(CAST(floor(128 * share + 0.5) AS BIGINT))), 2, '0') || lpad(lower(hex(CAST(floor(64 * share + 0.5) AS BIGINT))), 2, '0') AS colour,
  n_active >= greatest(3, ceil(most * 0.6)) AS hot FROM t"""


def renumber(spark: SparkSession, d: str) -> DataFrame:
    return mutate.renumbered(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"))


Q["renumber"] = "SELECT c_custkey AS old_id, c_name, row_number() OVER (ORDER BY c_custkey) AS id FROM customer"

QUERIES = [
    corpus_summary, catalogue_filter, date_contains, date_overlaps, catalogue_sort, paginate, facet_values, nested_exists, vocab_lookup, time_buckets, century_ticks, era_label, roman_century,
    lane_pack, site_rollup, site_density, renumber,
]
