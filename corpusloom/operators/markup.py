"""Inline markup: tags as rows, nesting by running balance, residue rules, line differences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions import diff
from corpusloom.functions.markup import LINEARISED, TOKENS, linearise, tokenize

TAG = r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*?)(/?)>"

#: Sigla that belong to a printed edition and shouldn't be left in marked-up text.
RESIDUE = {"square": r"\[[^\]<>]*\]", "angle": r"⟨[^⟩]*⟩", "double": r"⟦[^⟧]*⟧", "braces": r"\{[^}<>]*\}", "dots": r"\.\.\.|…", "hyphen": r"-\s*<lb\b"}


def tags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name, step): step is 1 for an opening tag, -1 for a closing one, 0 for an empty one."""
    each = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(0))).alias("pos", "tag"))
    step = F.when(F.startswith("tag", F.lit("</")), -1).when(F.endswith("tag", F.lit("/>")), 0).otherwise(1)
    return each.select(key, "pos", F.lower(F.regexp_extract("tag", r"^</?([A-Za-z0-9]+)", 1)).alias("name"), step.alias("step"))


def outside(found: DataFrame, key: str, inner: str, outer: str) -> DataFrame:
    """(key, n_inner, n_outside): openings of ``inner`` while no ``outer`` is open, by its running balance."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.when(F.col("name") == outer, F.col("step"))).over(w), F.lit(0))
    opened = found.withColumn("depth", depth).where((F.col("name") == inner) & (F.col("step") >= 0))
    return opened.groupBy(key).agg(F.count("*").alias("n_inner"), F.count_if(F.col("depth") <= 0).alias("n_outside"))


def balance(found: DataFrame, key: str) -> DataFrame:
    """(key, name, open, closed) of the names that don't come out even."""
    sums = found.groupBy(key, "name").agg(F.count_if(F.col("step") == 1).alias("open"), F.count_if(F.col("step") == -1).alias("closed"))
    return sums.where(F.col("open") != F.col("closed"))


def issues(docs: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(key, rule): which patterns a text still has; advice, so no row is dropped."""
    rules = RESIDUE if rules is None else rules
    each = F.explode(F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(name)) for name, p in rules.items())))).alias("rule")
    return docs.select(key, each)


def spans(c: Column, name: str) -> Column:
    """The inner texts of an element that doesn't nest in itself."""
    return F.regexp_extract_all(c, F.lit(f"(?s)<{name}(?:\\s[^>]*)?>(.*?)</{name}>"), F.lit(1))


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, error, tokens): the strict token list, flat with paths; an error instead of a crash."""
    return docs.select(key, F.udf(tokenize, TOKENS, useArrow=True)(F.col(text)).alias("t")).select(key, "t.error", "t.tokens")


def line_breaks(found: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, n, path, break_no, at_root) of the line breaks of an edition, numbered from 1."""
    breaks = F.filter(tokens, lambda t: t["name"] == "lb")
    rows = found.select(key, F.posexplode(breaks).alias("i", "t"))
    return rows.select(key, (F.col("i") + 1).alias("n"), F.col("t.path").alias("path"), F.coalesce(F.element_at("t.attrs", "break") == "no", F.lit(False)).alias("break_no"), (F.size("t.path") == 1).alias("at_root"))


#: Rules on the tokens of an edition, and whether breaking one is an error.
EDITION_RULES = {
    "not_well_formed": True, "leiden_residue": False, "attribute_in_text": True, "empty_attribute": True, "unit_not_ascii": True, "unit_unknown": True, "first_line_continues": True, "hyphen_before_line": False,
    "nymref_on_person": True, "nymref_on_epithet": True, "key_on_epithet": True, "epithet_outside_person": True, "epithet_after_coordinated": False, "divine_without_name": False, "divine_without_key": False,
    "epithet_in_key": False, "office_without_key": False, "gap_of_zero": True, "gap_without_extent": True,
}


def edition_issues(found: DataFrame, key: str, tokens: str = "tokens", error: str = "error") -> DataFrame:
    """(key, line, rule, severity) of what tokens (see ``tokens``) of an edition break; a line of 0 is the whole.

    Tokens are rows of one shuffle: what precedes one is found by windows, what is above and right below it the token
    says.  Only the rare ruler whose key names an epithet is looked up among all tokens.  Each empty attribute counts.
    """
    every = F.col(tokens)
    of = lambda t, name: F.coalesce(F.element_at(t["attrs"], name), F.lit(""))
    is_epithet = lambda t: t["name"].eqNullSafe("rs") & (of(t, "type") == "epithet")
    keyed = lambda t: t["name"].eqNullSafe("persName") & of(t, "type").isin("ruler", "emperor") & F.contains(F.lower(of(t, "key")), F.lit("theos"))
    below = lambda x, path: F.slice(x["path"], F.lit(1), F.size(path)) == path

    def says(t: Column) -> Column:
        """Whether the first epithet right below a token has a text."""
        first = F.get(F.filter(every, lambda e: is_epithet(e) & (F.size(e["path"]) == F.size(t["path"]) + 1) & below(e, t["path"])), F.lit(0))["path"]
        return F.exists(every, lambda x: (x["kind"] == "text") & (F.trim(x["value"]) != "") & below(x, first))

    broken_off = F.array(F.struct(F.lit(None).cast(found.schema[tokens].dataType.elementType).alias("t"), F.lit(False).alias("says")))
    looked = F.transform(every, lambda t: F.struct(t.alias("t"), F.when(keyed(t) & F.array_contains(t["kids"], "rs"), says(t)).otherwise(F.lit(False)).alias("says")))
    each = found.select(key, F.col(error).isNotNull().alias("malformed"), F.posexplode(F.when(F.col(error).isNotNull(), broken_off).otherwise(looked)).alias("i", "x"))
    t = F.col("x.t")
    attr = lambda name: of(t, name)
    rows = each.select(
        key, "malformed", "i", "x.says", t["kind"].alias("kind"), t["name"].alias("name"), t["value"].alias("value"), t["attrs"].alias("attrs"), t["above"].alias("above"), t["kids"].alias("kids"),
        F.slice(t["path"], F.lit(1), F.size(t["path"]) - 1).alias("parent"), F.element_at(t["path"], -1).alias("nth"), keyed(t).alias("keyed"), *(attr(a).alias(f"a_{a}") for a in ("type", "key", "nymRef", "unit", "break", "quantity", "atLeast", "extent")),
    )
    is_ = lambda name: F.col("name").eqNullSafe(name)
    text, lb, epithet, divine = F.col("kind") == "text", is_("lb"), is_("rs") & (F.col("a_type") == "epithet"), is_("persName") & (F.col("a_type") == "divine")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    place, siblings = before(Window.partitionBy(key).orderBy("i")), before(Window.partitionBy(key, "parent").orderBy("nth"))
    whole = rows.select(
        "*",
        F.count_if(lb).over(place).alias("breaks"),
        F.last(F.when(text | lb, F.struct("kind", "value")), ignorenulls=True).over(place).alias("said"),
        F.count_if(divine).over(siblings).alias("beside"),
    )
    alone, has, odd = epithet & ~F.array_contains("above", "persName"), lambda a: F.col(f"a_{a}") != "", F.col("a_unit").rlike(r"[^\x00-\x7F]")
    rules = [
        ("not_well_formed", F.col("malformed")),
        ("leiden_residue", F.col("value").rlike(r"[\[\]{}]|- - -")),
        ("attribute_in_text", F.col("value").rlike(r'[A-Za-z:_-]+\s*=\s*"[^"]*"')),
        ("unit_not_ascii", has("unit") & odd),
        ("unit_unknown", has("unit") & ~F.col("a_unit").isin("character", "line") & ~odd),
        ("first_line_continues", lb & (F.col("a_break") == "no") & (F.col("breaks") == 0)),
        ("hyphen_before_line", lb & (F.col("said.kind") == "text") & F.col("said.value").rlike(r"-\s*$")),
        ("nymref_on_person", is_("persName") & has("nymRef")),
        ("nymref_on_epithet", epithet & has("nymRef")),
        ("key_on_epithet", epithet & has("key")),
        ("epithet_outside_person", alone & (F.col("beside") < 2)),
        ("epithet_after_coordinated", alone & (F.col("beside") >= 2)),
        ("divine_without_name", divine & (F.size("kids") > 0) & ~F.array_contains("kids", "name")),
        ("divine_without_key", divine & ~has("key")),
        ("epithet_in_key", F.col("keyed") & F.col("says")),
        ("office_without_key", is_("rs") & (F.col("a_type") == "office") & ~has("key")),
        ("gap_of_zero", is_("gap") & (F.col("a_quantity") == "0")),
        ("gap_without_extent", is_("gap") & ~has("quantity") & ~has("atLeast") & ~has("extent")),
    ]
    empty = F.transform(F.filter(F.map_values("attrs"), lambda v: v == ""), lambda v: F.lit("empty_attribute"))
    listed = F.concat(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules))), F.coalesce(empty, F.array().cast("array<string>")))
    broken = whole.select(key, F.when(F.col("malformed"), 0).otherwise(F.greatest("breaks", F.lit(1))).cast("int").alias("line"), F.explode(listed).alias("rule"))
    errors = [name for name, hard in EDITION_RULES.items() if hard]
    return broken.withColumn("severity", F.when(F.col("rule").isin(*errors), "error").otherwise("warning"))


def searchable(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, ranges): an edition as running text, and where it is a supplement."""
    return docs.select(key, F.udf(linearise, LINEARISED, useArrow=True)(F.col(text)).alias("t")).select(key, "t.text", "t.ranges")


#: Rows, and characters of them, that close an Arrow batch of differences.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 23


def _differences(pairs: DataFrame, key: str, before: str, after: str, fields: list[StructField], of) -> DataFrame:
    """key and what ``of(before, after)`` yields, a row each; streamed in Arrow batches."""
    schema = StructType([pairs.schema[key], *fields])
    kinds, names = [to_arrow_type(f.dataType) for f in schema], schema.names

    def run(batches):
        held, chars = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for part in batches:
            for i in range(part.num_rows):
                k, a, b = (part.column(c)[i].as_py() for c in range(3))
                for row in of(a, b):
                    held.append((k, *row))
                    chars += sum(len(x) for x in row if isinstance(x, str))
                    if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch()
                        held, chars = [], 0
        if held:
            yield batch()

    return pairs.select(key, F.col(before).alias("before"), F.col(after).alias("after")).mapInArrow(run, schema)


def line_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, n_added, n_removed, n_same) lines between two versions."""
    fields = [StructField(n, LongType()) for n in ("n_added", "n_removed", "n_same")]
    return _differences(pairs, key, before, after, fields, lambda a, b: [diff.counts(a, b)])


def diff_rows(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, row, left_no, right_no, left, right, kind): two versions side by side, rows from 1 (see ``functions.diff.rows``)."""
    fields = [*(StructField(n, LongType()) for n in ("row", "left_no", "right_no")), *(StructField(n, StringType()) for n in ("left", "right", "kind"))]
    return _differences(pairs, key, before, after, fields, lambda a, b: ((i, *row) for i, row in enumerate(diff.rows(a, b), 1)))


#: Characters after a deity's name within which an epithet of its own is suspicious: a fixed value.
NEARBY = 120


def epithet_issues(docs: DataFrame, key: str, edition: str) -> DataFrame:
    """(key, at, problem, snippet): epithets apart from their deities, and attributes that don't belong where they are.

    An edition is cut before every tag; where tags lie and which comes next is found by windows over the pieces, so
    the cost grows with the number of tags.  ``at`` is a 0-based character offset.
    """
    cut = F.split(F.replace(F.col(edition), F.lit("<"), F.lit("\x01<")), "\x01")
    pieces = docs.select(key, F.posexplode(cut).alias("pos", "piece"))
    place = Window.partitionBy(key).orderBy("pos")
    before, later = place.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda pattern: F.col("piece").rlike(f"^{pattern}")
    named = F.length(F.regexp_extract("piece", r'^<rs\s+[^>]*type="epithet"', 0))
    found = pieces.select(
        key, "pos", "piece",
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("at"),
        is_(r"<persName\b[^>]*>").alias("opens"), is_("</persName>").alias("closes"), is_("</rs>").alias("ends"),
        is_(r'<persName\s+[^>]*type="divine"[^>]*>').alias("deity"), is_(r'<rs\s+[^>]*type="epithet"[^>]*>').alias("epithet"), named.alias("named"),
    )
    found = found.select(
        "*",
        (F.sum(F.col("opens").cast("int")).over(before) - F.sum(F.col("closes").cast("int")).over(before)).alias("depth"),
        F.min(F.when(F.col("closes"), F.col("at"))).over(later).alias("person_end"),
        F.min(F.when(F.col("ends"), F.col("at"))).over(later).alias("rs_end"),
        F.min(F.when(F.col("named") > 0, F.col("at"))).over(later).alias("next_at"),
        F.min(F.when(F.col("named") > 0, F.col("at") + F.col("named"))).over(later).alias("next_named"),
    )
    # What begins inside another of its kind is part of that one.
    free = lambda kind, end: F.col(kind) & F.col(end).isNotNull() & (F.col("at") > F.coalesce(F.max(F.when(F.col(kind), F.col(end))).over(before), F.lit(-1)))
    found = found.select("*", free("deity", "person_end").alias("person"), free("epithet", "rs_end").alias("rs")).where("person OR rs")
    end = F.when(F.col("rs"), F.col("rs_end") + len("</rs>")).otherwise(F.col("person_end") + len("</persName>"))
    found = found.join(docs.select(F.col(key).alias("__key"), F.col(edition).alias("__edition")), F.col(key) == F.col("__key"))
    whole = F.substr("__edition", F.col("at") + 1, end - F.col("at"))
    alone = F.coalesce(F.col("next_at") > F.col("person_end"), F.lit(True))
    near = F.coalesce(F.col("next_named") <= F.col("person_end") + len("</persName>") + NEARBY, F.lit(False))
    tag = F.split_part("piece", F.lit(">"), F.lit(1))
    checks = {
        "epithet_outside_person": F.col("rs") & (F.coalesce("depth", F.lit(0)) <= 0),
        "nymref_on_epithet": F.col("rs") & F.contains(whole, F.lit("nymRef=")),
        "key_on_epithet": F.col("rs") & F.contains(whole, F.lit("key=")),
        "epithet_nearby": F.col("person") & alone & near,
        "nymref_on_person": F.col("person") & F.contains(tag, F.lit("nymRef=")),
    }
    listed = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in checks.items())))
    snippet = F.substring(F.regexp_replace(whole, r"\s+", " "), 1, 90)
    issues = found.select(key, "at", F.explode(listed).alias("problem"), snippet.alias("snippet"))
    hyphens = docs.select(key, F.regexp_extract_all(edition, F.lit(r"(?m)<lb[^>]*/>[^<]*-\s*$"), F.lit(0)).alias("found")).where(F.size("found") > 0)
    first = F.substring(F.regexp_replace(F.element_at("found", 1), r"\s+", " "), 1, 90)
    return issues.unionByName(hyphens.select(key, F.lit(None).cast("long").alias("at"), F.concat(F.lit("hyphen_at_line_end "), F.size("found")).alias("problem"), first.alias("snippet")))
