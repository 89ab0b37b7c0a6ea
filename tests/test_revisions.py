import random
import re
import time
import tracemalloc
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from compare import DATA
from corpusloom.functions import diff
from corpusloom.operators import catalogue, markup, records, search, timeline
from corpusloom.plans import fields, revisions, texts, views
from corpusloom.plans.views import table


def longest(a, b):
    @lru_cache(None)
    def of(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + of(i + 1, j + 1) if a[i] == b[j] else max(of(i + 1, j), of(i, j + 1))

    return of(0, 0)


def check(a, b):
    found = diff.common(list(a), list(b))
    assert all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:]))
    assert all(a[i] == b[j] for i, j in found) and len(found) == longest(tuple(a), tuple(b))


def test_scripts_are_shortest():
    for n, m in product(range(5), range(5)):
        for a in product(range(3), repeat=n):
            for b in product(range(3), repeat=m):
                check(a, b)
    rng = random.Random(3)
    for _ in range(500):
        k = rng.randint(1, 8)
        check([rng.randrange(k) for _ in range(rng.randint(0, 30))], [rng.randrange(k) for _ in range(rng.randint(0, 30))])


def test_rows_rebuild_both_sides():
    rng = random.Random(5)
    for _ in range(300):
        before, after = ("".join(rng.choice(["a\n", "b\n", "\n", "c d\n", "e"]) for _ in range(rng.randint(0, 15))) for _ in range(2))
        found = list(diff.rows(before, after))
        assert [r[2] for r in found if r[0]] == diff.lines(before) and [r[3] for r in found if r[1]] == diff.lines(after)
        assert [r[0] for r in found if r[0]] == list(range(1, len(diff.lines(before)) + 1))
        assert all((r[4] == "same") == (r[2] == r[3] and None not in r[:2]) or r[4] == "removed" for r in found)
    assert list(diff.rows("a\nb\nc", "a\nx\ny\nc\n")) == [(1, 1, "a", "a", "same"), (2, 2, "b", "x", "removed"), (None, 3, None, "y", "added"), (3, 4, "c", "c", "same")]
    assert list(diff.rows(None, "")) == [] and list(diff.rows("a", None)) == [(1, None, "a", None, "removed")]


def test_long_texts_take_linear_memory():
    rng = random.Random(7)
    left = [f"line {i}" for i in range(200_000)]
    right = list(left)
    for _ in range(300):
        i = rng.randrange(len(right))
        right[i : i + rng.randint(0, 3)] = [left[rng.randrange(len(left))] for _ in range(rng.randint(0, 2))]
    before, after = "\n".join(left), "\n".join(right)
    tracemalloc.start()
    began = time.perf_counter()
    added, removed, same = diff.counts(before, after)
    assert same + added == len(right) and same + removed == 200_000 and same > 199_000
    assert tracemalloc.get_traced_memory()[1] < 500e6 and time.perf_counter() - began < 120
    tracemalloc.stop()


def test_differences_as_rows(spark):
    pairs = spark.createDataFrame([("k", "a\nb", "b\nc", 1), (None, None, "x", 2), ("e", "", "", 3)], "key string, before string, after string, row long")
    got = sorted((tuple(r) for r in markup.diff_rows(pairs, "key", "before", "after").collect()), key=repr)
    assert got == sorted([("k", 1, 1, None, "a", None, "removed"), ("k", 2, 2, 1, "b", "b", "same"), ("k", 3, None, 2, None, "c", "added"), (None, 1, None, 1, None, "x", "added")], key=repr)
    assert {(r.key, r.n_added, r.n_removed, r.n_same) for r in markup.line_diff(pairs, "key", "before", "after").collect()} == {("k", 1, 1, 1), (None, 1, 1, 0), ("e", 0, 0, 1)}
    assert markup.diff_rows(pairs.limit(0), "key", "before", "after").count() == 0


def drawn(boxes):
    """The drawing of one axis, step by step."""
    up, down, placed = [], [], []
    for i, (left, key, n) in enumerate(sorted(boxes)):
        lanes = [next((k for k, lane in enumerate(side) if left - 86 >= lane[-1][0] + 86 + 12), len(side)) for side in (up, down)]
        side = up if lanes[0] < lanes[1] or (lanes[0] == lanes[1] and i % 2 == 0) else down
        lane = lanes[0] if side is up else lanes[1]
        if lane == len(side):
            side.append([])
        side[lane].append((left, n))
        placed.append((key, "up" if side is up else "down", lane, i))
    high = lambda n: 42 if n <= 1 else 30 + min(40 * n, 108) + 6
    out = set()
    for key, name, lane, i in placed:
        before = (up if name == "up" else down)[:lane]
        out.add((key, name, lane, 20 + sum(max(high(n) for _, n in boxes_) + 14 for boxes_ in before), min(34, 12 + 7 * lane) * (1 if i % 2 == 0 else -1)))
    return out


def test_two_sided_lanes(spark):
    rng = random.Random(2)
    rows = [(g, i, float(rng.randint(0, 1500)), rng.choice([1, 1, 2, 5])) for g in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id long, x double, n long").repartition(4)
    got = timeline.two_sided(df, "g", key="id", left="x", n="n")
    for g in ("a", "b", None):
        mine = {(r.id, r.side, r.lane, r.connector, r.bend) for r in got.collect() if r.g == g}
        assert mine == drawn([(x, i, n) for h, i, x, n in rows if h == g])
    reach = {r.g: r.reach for r in timeline.vertical_reach(got, "g", "n").collect()}
    assert reach["a"] == max(r.connector + (42 if r.n <= 1 else 36 + min(40 * r.n, 108)) for r in got.collect() if r.g == "a") + 40


def test_names_sort_by_language(spark):
    names = ["Zo", "ab", "Àb", "aB", "áa", "b-c", "bb", "B c", None, " ", "ab"]
    df = spark.createDataFrame([(i, n, "R") for i, n in enumerate(names)], "id long, tipo string, regione string")
    assert [r.tipo for r in catalogue.ordered(df, "tipo").collect()] == [" ", "áa", "ab", "ab", "aB", "Àb", "B c", "b-c", "bb", "Zo", None]
    assert [r.id for r in catalogue.ordered(df, "id", ascending=False).collect()][:2] == [10, 9]
    assert [r.value for r in catalogue.suggestions(df, "tipo").collect()] == ["áa", "ab", "aB", "Àb", "B c", "b-c", "bb", "Zo"]
    cities = spark.createDataFrame([(1, None, "ò"), (2, "P", "a"), (3, "à", None), (4, None, None)], "id long, regione string, citta string")
    assert [r.id for r in catalogue.ordered(cities, "citta").collect()] == [4, 3, 1, 2]


def scanned(edition):
    """The rules on epithets, by searching forward from every match."""
    out = []
    person, epithet = r'<persName\s+[^>]*type="divine"[^>]*>([\s\S]*?)</persName>', r'<rs\s+[^>]*type="epithet"[^>]*>([\s\S]*?)</rs>'
    for m in re.finditer(epithet, edition):
        before = edition[: m.start()]
        if len(re.findall(r"<persName\b[^>]*>", before)) <= len(re.findall("</persName>", before)):
            out.append((m.start(), "epithet_outside_person"))
        out += [(m.start(), f"{a.lower()}_on_epithet") for a in ("nymRef", "key") if f"{a}=" in m[0]]
    for m in re.finditer(person, edition):
        if not re.search(r'<rs\s+[^>]*type="epithet"', m[1]) and re.search(r'<rs\s+[^>]*type="epithet"', edition[m.end() : m.end() + 120]):
            out.append((m.start(), "epithet_nearby"))
        if "nymRef=" in m[0].split(">")[0]:
            out.append((m.start(), "nymref_on_person"))
    found = re.findall(r"(?m)<lb[^>]*/>[^<]*-\s*$", edition)
    return out + ([(None, f"hyphen_at_line_end {len(found)}")] if found else [])


def test_epithets_near_their_deities(spark):
    rng = random.Random(9)
    parts = ['<persName type="divine" key="A">', '<persName type="divine" nymRef="q">', "<persName>", "</persName>", '<rs type="epithet">', '<rs key="k" type="epithet" nymRef="n">', "</rs>", '<lb n="1"/>', "x" * 40, "x" * 75, "ab-\n", "-", "<name>", "</name>", '<rs type="office">']
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(400)] + [(-1, None), (-2, "")]
    for gap in range(80, 125):
        rows.append((1000 + gap, f'<persName type="divine">a</persName>{"y" * gap}<rs type="epithet">b</rs>'))
    got = markup.epithet_issues(spark.createDataFrame(rows, "id long, edition string"), "id", "edition").collect()
    assert sorted((r.id, str(r["at"]), r.problem) for r in got) == sorted((i, str(at), p) for i, e in rows if e for at, p in scanned(e))


def test_kept_index_follows_files(spark, tmp_path):
    """A table rewritten under an index that was kept gives no stale hits."""
    rows = lambda *texts: spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    path = f"{tmp_path}/documents.parquet"
    rows("the old text", "more of the same").write.parquet(path)
    assert {r.doc_id for r in texts.search_or(spark, str(tmp_path)).collect()} == {0, 1}
    rows("nothing here", "more of the same", "the end").write.mode("overwrite").parquet(path)
    assert {r.doc_id for r in texts.search_or(spark, str(tmp_path)).collect()} == {1, 2}
    want = search.search(search.index_of(search.postings(table(spark, str(tmp_path), "documents"), texts.FIELDS, id="doc_id")), "Thé réau ciónes", prefix=False, fuzzy=0)
    assert {(r.id, round(r.score, 4), r.n_words) for r in want.collect()} == {(r.doc_id, r.score, r.n_words) for r in texts.search_or(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("query", [revisions.epithet_nearby, revisions.edition_faults, fields.edition_indices, fields.record_fields])
def test_much_work_is_dealt_by_rows(spark, monkeypatch, query):
    """A table in one file is dealt by its key into parts by its rows before much is done with each row."""
    monkeypatch.setattr(views, "DEALT_ROWS", 20)
    plan = query(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(p_partkey#\d+L?, 10\), REPARTITION_BY_NUM", plan)


def test_pieces_of_editions_are_not_moved(spark):
    """Windows over the pieces of an edition are where the edition was dealt to."""
    plan = revisions.epithet_nearby(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\([^\n]*", plan) and all("REPARTITION_BY_NUM" in x for x in re.findall(r"Exchange hashpartitioning\([^\n]*", plan))


def test_edition_index_is_read_once(spark):
    plan = fields.edition_indices(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_fields_in_lists_are_read_once(spark):
    """Whether a field is empty is asked of what was read, not by reading again."""
    rows = spark.createDataFrame([(['k="a"', 'k=""', "x"],)], "x array<string>")
    one = rows.select(F.transform("x", lambda x: records.filled(F.regexp_extract(x, 'k="([^"]*)"', 1), F.nullif(x, F.lit("x")))).alias("y"))
    assert one.first().y == ["a", 'k=""', None]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
