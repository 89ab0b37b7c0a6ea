"""Counts over scalar and set-valued fields, co-occurrence and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts below this are too low to read anything into.
LOW, CLEAR = 3, 1.0


def summary(records: DataFrame, *, region: str = "regione", city: str = "citta", start: str = "data_inizio", end: str = "data_fine") -> DataFrame:
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return records.agg(
        F.count("*").alias("n_records"), F.countDistinct(filled(region)).alias("n_regions"), F.countDistinct(filled(city)).alias("n_cities"), F.min(start).alias("first_year"), F.max(end).alias("last_year")
    )


def value_stats(values: DataFrame, value: str, region: str) -> DataFrame:
    """(value, n, n_regions) of one row per record and value."""
    return values.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col(region) != "", F.col(region))).alias("n_regions"))


def entity_stats(values: DataFrame, entity: str, part: str, region: str) -> DataFrame:
    """(value, n, n_regions, parts): the parts of an entity with counts, most frequent first."""
    inner = values.where(F.col(part).isNotNull()).groupBy(F.col(entity).alias("value"), F.col(part).alias("part")).agg(F.count("*").alias("k"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("down"), "part")))
    lists = inner.groupBy("value").agg(F.array_join(F.transform(ranked, lambda x: F.concat(x["part"], F.lit(":"), (-x["down"]).cast("string"))), "|").alias("parts"))
    return value_stats(values, entity, region).join(lists, "value", "left")


def axis_values(record: str, values: Column, source: DataFrame) -> DataFrame:
    """(record, value), a row for each distinct non-empty value of an array or singleton column."""
    return source.select(F.col(record).alias("record"), F.explode(F.array_distinct(values)).alias("value")).where(F.col("value") != "")


def cooccurrence(rows: DataFrame, columns: DataFrame, total: Column | int) -> DataFrame:
    """(row_value, col_value, n, row_n, col_n, pmi, reading) of two axes of (record, value).

    ``total`` counts all records, those without values too.  The pairs of a record
    are few, as its values are; frequent values meet only as sums.
    """
    r, c = rows.distinct(), columns.distinct()
    pairs = r.withColumnRenamed("value", "row_value").join(c.withColumnRenamed("value", "col_value"), "record")
    pairs = pairs.groupBy("row_value", "col_value").agg(F.count("*").alias("n"))
    return with_pmi(pairs, r, c, total)


def with_pmi(pairs: DataFrame, rows: DataFrame, columns: DataFrame, total: Column | int) -> DataFrame:
    total = total if isinstance(total, Column) else F.lit(total)
    by = lambda x, name: x.groupBy(F.col("value").alias(f"{name}_value")).agg(F.count("*").alias(f"{name}_n"))
    out = pairs.join(by(rows, "row"), "row_value").join(by(columns, "col"), "col_value")
    pmi = F.log2(F.col("n") * total / (F.col("row_n") * F.col("col_n")))
    out = out.withColumn("pmi", F.when(F.col("n") > 0, pmi))
    shown = F.round("pmi", 6)  # so that equal shares read alike
    reading = F.when(F.col("n") == 0, "none").when(F.col("n") < LOW, "low").when(shown >= CLEAR, "stronger").when(shown <= -CLEAR, "weaker").otherwise("expected")
    return out.withColumn("reading", reading).select("row_value", "col_value", "n", "row_n", "col_n", "pmi", "reading")


def variant_conflicts(values: DataFrame, value: str, key: Column) -> DataFrame:
    """(key, n_variants, variants, n_uses): folded keys that are spelt in more than one way.

    Variants are listed by falling count, then by name.  Each spelling is folded once, after it is counted.
    """
    counted = values.groupBy(value).agg(F.count("*").alias("k"))
    each = counted.select(key.alias("key"), F.col(value).alias("variant"), "k").where(F.col("key") != "")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("down"), "variant")))
    grouped = each.groupBy("key").agg(F.count("*").alias("n_variants"), F.array_join(F.transform(ranked, lambda x: x["variant"]), "|").alias("variants"), F.sum("k").alias("n_uses"))
    return grouped.where(F.col("n_variants") > 1)


#: The indices that are looked through for spellings, and the axes of a co-occurrence: fixed values.
REPORTS = ("divinita", "epiteti", "onomastica", "citta", "regione", "tipo", "materiale")
AXES = ("epiteti", "divinita", "onomastica", "imperatori", "materiale", "tipo", "regione", "function", "trait")


def axis(name: str) -> Column:
    """A record's values on an axis, as an array: its lists, single values, its function or its figures' distinct traits."""
    if name in ("divinita", "epiteti", "onomastica", "imperatori"):
        return F.array_distinct(F.coalesce(F.col(name), F.array().cast("array<string>")))
    if name == "function":
        return F.array_compact(F.array("iconografia.function"))
    if name == "trait":
        return F.coalesce(F.array_distinct(F.flatten(F.transform("iconografia.figures", lambda f: F.transform(f["traits"], lambda t: t["key"])))), F.array().cast("array<string>"))
    return F.filter(F.array(name), lambda v: F.coalesce(v != "", F.lit(False)))


def variant_reports(records: DataFrame, fold, reports: tuple[str, ...] = REPORTS) -> DataFrame:
    """(report, key, n_variants, variants, n_uses) of every index, counted in one pass."""
    named = lambda r: F.transform(axis(r), lambda v: F.struct(F.lit(r).alias("report"), v.alias("value")))
    each = F.explode(F.concat(*map(named, reports))).alias("x")
    counted = records.select(each).groupBy("x.report", "x.value").agg(F.count("*").alias("k"))
    each = counted.select("report", fold(F.col("value")).alias("key"), F.col("value").alias("variant"), "k").where(F.col("key") != "")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("down"), "variant")))
    grouped = each.groupBy("report", "key").agg(F.count("*").alias("n_variants"), F.array_join(F.transform(ranked, lambda x: x["variant"]), "|").alias("variants"), F.sum("k").alias("n_uses"))
    return grouped.where(F.col("n_variants") > 1)


def conflicts(reports: DataFrame) -> DataFrame:
    """(report, n), and their sum under a null report."""
    return reports.rollup("report").agg(F.count("*").alias("n"))


def distinct_epithets(records: DataFrame) -> DataFrame:
    """(divinita, n): the distinct epithets of every deity, and of all under a null one."""
    pairs = records.select(F.explode("divinitaEpiteti").alias("x")).select("x.divinita", F.explode("x.epiteti").alias("epiteto")).distinct()
    return pairs.rollup("divinita").agg(F.countDistinct("epiteto").alias("n"))


def missing(records: DataFrame, **rules: Column) -> DataFrame:
    """(rule, n, first_id): how many records each rule finds lacking; one pass, whatever the number of rules."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("hit")) for k, v in rules.items()))).alias("x")
    return records.select("id", each).groupBy("x.rule").agg(F.count_if("x.hit").alias("n"), F.min(F.when(F.col("x.hit"), F.col("id"))).alias("first_id"))
