"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gives counts (words, symbols, repeated lines, words in repeated
5-word windows).  A fixed base rule rejects texts of under ten words or of more
than a fifth repeated words.  The other cutoffs adapt: four measures are kept per
language and source in mergeable quantile sketches, histograms of fixed
resolution (one per mille, or a hundredth of a character) and at most
``BINS + 1`` bins, so any quantile is off by at most one bin.  They are
aggregated before the shuffle, so a source with a third of all rows costs each
task one row per bin.  A text is rejected where a measure lies beyond its
group's fence: upper quartile plus three quartile ranges plus a slack that keeps
groups without spread from rejecting ordinary texts.

Sketches merge upwards: a group of under ``LEAST`` texts, and one so polluted that
its fence lies outside what the measure can reach, takes the fence of its
language, and where the same holds of that, the whole corpus's.

Null texts have no words and fail the base rule.  Null languages and sources are
groups of their own.  Equal rows get equal verdicts; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST, BINS, SPREAD = 5, 20, 2000, 3
#: What a measure can reach where its bins don't end at ``BINS``.
REACH = {"symbol_pm": 1000, "dup_line_pm": 1000, "repeat_pm": 1000}
#: Measures and the slack of their fences: a text of which under 30 % of the lines repeat, or 5 % of the characters are symbols, is never beyond.
SLACK = {"symbol_pm": 50, "dup_line_pm": 300, "repeat_pm": 100, "word_len_c": 200}
#: More rejected rows than this are joined by a shuffle, fewer are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body's lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(x: Column) -> Column:
            same_next = F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
            return _let(same_next, lambda e: cover(F.array_sort(F.filter(F.zip_with(x, F.zip_with(e, F.concat(F.array(F.lit(False)), F.slice(e, F.lit(1), F.size(e) - 1)), lambda a, b: a | b), lambda a, f: F.when(f, a["i"])), lambda i: i.isNotNull()))))

        def cover(at: Column) -> Column:
            gaps = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
            return F.aggregate(_let(at, gaps), F.lit(0).cast("long"), lambda acc, n: acc + n)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(placed, of_sorted))

    def of_words(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - size)
        hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size))))
        return F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(_let(hashes, covered))

    return _let(words, of_words)


def measured(docs: DataFrame, *, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """The counts of every text, one row per row of docs; ``fp`` tells rows of one id apart."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    # One array per row serves the counts of words and of repeats; the lambda binds it once.
    both = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    dup = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return base.select(
        "doc_id",
        F.xxhash64("text").alias("fp"),
        "lang",
        "source",
        both.alias("w"),
        dup.alias("l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(
        "doc_id",
        "fp",
        "lang",
        "source",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.d").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
    )


def _measures() -> dict[str, Column]:
    per = lambda a, b, k: F.floor(F.col(a) * k / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "symbol_pm": per("n_symbols", "word_chars", 1000),
        "dup_line_pm": per("n_dup_lines", "n_lines", 1000),
        "repeat_pm": per("n_repeat_words", "n_words", 1000),
        "word_len_c": F.least(per("word_chars", "n_words", 100), F.lit(BINS)),
    }


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the merged sketch of every group."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in SLACK))).alias("x")
    return rows.select("lang", "source", each).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """The upper fence of every group and measure; a row per group."""
    group = [F.col("lang"), F.col("source")]
    above = [[F.col("lang"), F.lit(None).cast("string")], [F.lit(None).cast("string")] * 2]  # its language, the whole corpus
    levels = None
    for level, (g_lang, g_source) in enumerate([group, *above]):
        part = sketch.select(F.lit(level).alias("level"), g_lang.alias("lang"), g_source.alias("source"), "measure", "bin", "n")
        levels = part if levels is None else levels.unionByName(part)
    w = Window.partitionBy("level", "lang", "source", "measure")
    merged = levels.groupBy("level", "lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bin")))
    of_measure = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("measure"))
    quartiles = ranked.groupBy("level", "lang", "source", "measure").agg(at(25).alias("q1"), at(75).alias("q3"), F.max("total").alias("total"))
    found = quartiles.withColumn("fence", F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")) + of_measure(SLACK))
    useful = (F.col("level") == 2) | ((F.col("total") >= LEAST) & (F.col("fence") < of_measure({m: REACH.get(m, BINS) for m in SLACK})))
    wide = found.groupBy("level", "lang", "source").agg(*(F.max(F.when((F.col("measure") == m) & useful, F.col("fence"))).alias(f"most_{m}") for m in SLACK))
    wide = scratch.table(wide, "fences")
    whole = wide.where("level = 2").first()  # a row with a number for each measure
    own, of_lang = (wide.where(F.col("level") == i).alias(f"l{i}") for i in range(2))
    joined = own.join(of_lang, F.col("l0.lang").eqNullSafe(F.col("l1.lang")), "left")
    fence = lambda m: F.coalesce(f"l0.most_{m}", f"l1.most_{m}", F.lit(whole and whole[f"most_{m}"]).cast("long"))
    return joined.select("l0.lang", "l0.source", *(fence(m).alias(f"most_{m}") for m in SLACK))


def judged(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: its counts, base_failed, reasons and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.table(measured(docs, doc_id=doc_id, text=text, lang=lang, source=source), "measured")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base_failed).withColumns(_measures())
    limits = fences(scratch.table(sketches(rows.where(~F.col("base_failed"))), "sketches"), scratch)
    limits = limits.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(f"most_{m}" for m in SLACK))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    beyond = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *(F.when(F.col(m) > F.col(f"most_{m}"), F.lit(m)) for m in SLACK)))
    return joined.select("doc_id", "fp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", beyond.alias("reasons"), (F.size(beyond) == 0).alias("kept"))


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    scratch = Scratch(docs.sparkSession, "rejects")
    found = judged(docs, doc_id=doc_id, text=text, lang=lang, source=source)
    bad = scratch.table(found.where(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("fp").alias("bad_fp")).distinct(), "bad")
    few = bad.count() <= BROADCAST_ROWS
    same = docs[doc_id].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text]) == bad["bad_fp"])
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")
