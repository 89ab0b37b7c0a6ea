import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import imports, markup, mutate, search
from corpusloom.operators import rules as rule_ops
from corpusloom.sources import corpus


def test_broken_ledgers(spark, tmp_path):
    bodies = {
        "good.json": '[{"entryId": "a", "status": "open", "notes": [{"id": "1", "testo": "x"}], "other": 3}, {"entryId": "b", "entryLabel": null}]',
        "cut.json": '[{"entryId": "c"}, {"entr', "object.json": '{"entryId": "d"}', "empty.json": " \n", "number.json": "3", "odd.json": '[{"entryId": "e"}, 7, null]', "none.json": "[]", "text.json": "not json",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    rows, errors = corpus.tolerant_ledger(spark, str(tmp_path))
    got = {r.entryId: r for r in rows.collect()}
    assert set(got) == {"a", "b", "e"} and got["a"].notes[0].testo == "x" and got["b"].status is None
    want = {("cut.json", "not JSON"), ("object.json", "not an array"), ("empty.json", "empty"), ("number.json", "not an array"), ("text.json", "not JSON"), ("odd.json", "element 1 is no object"), ("odd.json", "element 2 is no object")}
    assert {tuple(r) for r in errors.collect()} == want
    for found in corpus.tolerant_bugs(spark, str(tmp_path / "nowhere.json")):
        assert found.count() == 0
    assert corpus.tolerant_bugs(spark, str(tmp_path / "good.json"))[0].columns == ["id", "author", "testo", "status", "createdAt", "resolvedAt"]


def test_legacy_file_until_there_are_records(spark, tmp_path):
    folder, legacy = tmp_path / "corpus", tmp_path / "old.xml"
    assert corpus.docs_or_legacy(spark, str(folder), str(legacy)).count() == 0
    legacy.write_text("<teiCorpus><TEI>old</TEI></teiCorpus>")
    assert [r.file for r in corpus.docs_or_legacy(spark, str(folder), str(legacy)).collect()] == ["old.xml"]
    folder.mkdir()
    (folder / "_backup.xml").write_text("<TEI/>")
    assert [r.file for r in corpus.docs_or_legacy(spark, str(folder), str(legacy)).collect()] == ["old.xml"]
    (folder / "a.xml").write_text("<TEI/>")
    assert [r.file for r in corpus.docs_or_legacy(spark, str(folder), str(legacy)).collect()] == ["a.xml"]


def test_well_formed(spark):
    good = ["<a/>", "<?xml version='1.0'?><a b='1'>x &amp; y<!-- c --><b/></a>", "<a>é\n<![CDATA[<]]></a>"]
    bad = [None, "", "text", "<a>", "<a></b>", "<a b=1/>", "<a b='1' b='2'/>", "<a>&nope;</a>", "<a/><b/>", "<a>\n<b c='<'/></a>", "<a>&</a>", "<a>\x01</a>"]
    df = spark.createDataFrame(list(enumerate([*good, *bad])), "n long, xml string")
    got = {r.n: r for r in corpus.well_formed(df, "n", "xml").collect()}
    assert all(got[i].reason is None for i in range(len(good)))
    for i, text in enumerate(bad, len(good)):
        with pytest.raises(ET.ParseError) as fault:
            ET.fromstring(text or "")
        assert (got[i].line, got[i].column) == fault.value.position and got[i].reason
    kept, refused = corpus.savable(df, "n", "xml")
    assert kept.count() == len(good) and refused.count() == len(bad) and kept.columns == ["n", "xml"]
    assert corpus.well_formed(df.limit(0), "n", "xml").count() == 0


def test_one_ordered_file(spark, tmp_path):
    rng = random.Random(4)
    docs = [(f"r{i:04d}.xml", f"<?xml?>\n<TEI n='{i}'>\n  {'é' * rng.randint(0, 400)}\n</TEI>\n<!-- end -->") for i in range(700)] + [("_skip.xml", "<TEI/>"), ("none.xml", "<x/>")]
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "file string, xml string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    try:
        size = corpus.backup_file(df, str(tmp_path / "backup.xml"))
        corpus.snapshot_file(df, str(tmp_path / "snapshot.json"), "2024")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = corpus.BACKUP_HEAD + "".join("  " + x[x.index("<TEI") : x.index("</TEI>") + 6].replace("\n", "\n  ") + "\n" for f, x in sorted(docs) if "</TEI>" in x and f[0] != "_") + "</teiCorpus>"
    assert (tmp_path / "backup.xml").read_bytes() == want.encode() and size == len(want.encode())
    assert json.loads((tmp_path / "snapshot.json").read_text()) == {"generatedAt": "2024", "files": dict(docs)}
    assert {tuple(r) for r in corpus.snapshot(spark, str(tmp_path / "snapshot.json")).collect()} == set(docs)
    corpus.backup_file(df.limit(0), str(tmp_path / "backup.xml"))  # replaces the file
    assert (tmp_path / "backup.xml").read_text() == corpus.BACKUP_HEAD + "</teiCorpus>"
    assert {p.name.lstrip(".").removesuffix(".crc") for p in tmp_path.iterdir()} == {"backup.xml", "snapshot.json"}


def test_import_defaults(spark):
    rows = [(7, None, "", "R", ["Iscrizione Greca", "x"], [("l", "n"), ("m", "o")], ["Zeus"], 30), (None, "e", "T", None, None, None, None, 10), (0, "", None, "", [], [], [], 20)]
    df = spark.createDataFrame(rows, "id long, entryId string, titolo string, regione string, textTypes array<string>, apparatus array<struct<loc:string,note:string>>, onomastica array<string>, ord long")
    existing = spark.createDataFrame([(4,), (9,)], "id long")
    got = {r.ord_: r for r in imports.defaulted(df.withColumn("ord_", F.col("ord")), existing, "ord", stamp="s").collect()}
    assert [(got[o].id, got[o].entryId, got[o].titolo) for o in (10, 20, 30)] == [(10, "e", "T"), (11, "gen-s-2", "Scheda #2"), (7, "gen-s-3", "Scheda #7")]
    assert got[30].textTypes == ["x"] and got[30].testo_tradotto == "l: n\nm: o" and got[30].onomastica == ["Zeus"]
    assert (got[10].regione, got[10].dim_unita, got[10].iscrizione, got[10].phi, got[10].data_inizio) == ("", "metre", False, [], None)
    bare = imports.defaulted(spark.createDataFrame([(1, "5"), (2, "x")], "ord long, data_inizio string"), existing.limit(0), "ord").orderBy("id").collect()
    assert [(r.id, r.titolo, r.data_inizio, r.apparatus) for r in bare] == [(1, "Scheda #1", 5.0, ""), (2, "Scheda #2", None, "")]


def test_tags_find_records(spark):
    docs = spark.createDataFrame([(1, "Ἄρτεμις stone"), (2, "stone temple"), (3, "other")], "id long, body string")
    index = search.index_of(search.postings(docs, {"body": 2.0}))
    notes = spark.createDataFrame([("n", "see #stone and #stone, #none"), ("m", "x#other #"), ("o", None)], "key string, text string")
    assert {tuple(r) for r in mutate.tags(notes, text="text", key="key").collect()} == {("n", "#stone"), ("n", "#none"), ("m", "#other")}
    hits = {(r.tag, r.id): round(r.score, 9) for r in mutate.tag_hits(notes, index, text="text", key="key").collect()}
    want = {(t, r.id): round(r.score, 9) for t in ("#stone", "#other") for r in search.search(index, t, prefix=False, fuzzy=0).collect()}
    assert hits == want and len(want) == 3
    two = spark.createDataFrame([("q", "stone temple"), ("r", "artemis αρτεμις")], "q string, t string")
    assert {(r["query"], r.id) for r in search.search_many(index, two, "q", "t", every=True).collect()} == {("q", 2)}


def test_last_status_counts(spark):
    notes = spark.createDataFrame([("E", "open", "1", None), ("F", "resolved", "1", "2"), ("G", "open", "1", None), (None, "open", "1", None)], "e string, status string, created string, resolved string")
    changes = spark.createDataFrame([("E", "resolved", "5"), ("E", "open", "7"), ("F", "resolved", "9"), ("G", "open", "3"), ("G", "resolved", "3"), (None, "resolved", "9")], "e string, status string, at string")
    got = sorted(map(tuple, mutate.status_set(notes, "e", changes).collect()), key=repr)
    assert got == sorted([("E", "open", "1", None), ("F", "resolved", "1", "9"), ("G", "resolved", "1", "3"), (None, "open", "1", None)], key=repr)


def test_shape_of_records(spark):
    figures = "struct<function:string,note:string,figures:array<struct<traits:array<string>,place:string>>>"
    schema = f"id double, regione string, citta string, tipo string, materiale string, testo string, note_interne string, note_interne_rawXml string, {', '.join(f'{f} array<string>' for f in 'epiteti divinita onomastica textTypes imperatori persone traduzioni bibliografia revisions'.split())}, iconografia {figures}"
    row = lambda id_, citta, figs: (id_, None, citta, *[None] * 5, *[None] * 9, (None, None, figs))
    long_place, many = ("p" * 51), ["t"] * 51
    cases = [
        (row(1.0, "x" * 200, None), None), (row(float("inf"), None, None), "id is no number from 0"), (row(float("nan"), None, None), "id is no number from 0"), (row(-1.0, None, None), "id is no number from 0"), (row(None, None, None), "id is no number from 0"),
        (row(1.0, "𐀀" * 101, None), "citta longer than 200"), (row(1.0, "𐀀" * 100, None), None),
        (row(1.0, None, [([], long_place), (many, None)]), "place longer than 50"), (row(1.0, None, [(many, long_place), ([], None)]), "traits more than 50"), (row(1.0, None, [([], "p"), (many, long_place)]), "traits more than 50"),
    ]
    got = spark.createDataFrame([r for r, _ in cases], schema).select(rule_ops.record_shape()).collect()
    assert [r[0] for r in got] == [want for _, want in cases]


def test_each_empty_attribute_and_deep_editions(spark):
    deep = "".join(f'<w n="{i}">' for i in range(120)) + '<rs type="epithet">x</rs>' + "</w>" * 120
    rows = [(1, '<lb n=""/><hi a="" b="" c="1">x</hi>'), (2, f'<persName type="attested">{deep}</persName>{deep}'), (3, '<persName type="ruler" key="A Theos"><rs type="epithet"> </rs><rs type="epithet">b</rs></persName>'), (None, '<gap/>'), (4, None)]
    found = markup.edition_issues(markup.tokens(spark.createDataFrame(rows, "id long, x string"), "id", "x"), "id").collect()
    got = sorted(((r.id, r.line, r.rule) for r in found), key=repr)
    assert got == sorted([(1, 1, "empty_attribute")] * 3 + [(2, 1, "epithet_outside_person"), (None, 1, "gap_without_extent")], key=repr)


def test_many_lines_are_no_burden(spark):
    import time

    edition = "".join(f'<lb n="{i}"/>abc <persName type="divine" key="K">d</persName> <gap/>' for i in range(3000))
    began = time.perf_counter()
    rows = markup.edition_issues(markup.tokens(spark.createDataFrame([(1, edition)], "id long, x string"), "id", "x"), "id").collect()
    assert sorted(r.line for r in rows) == list(range(1, 3001)) and time.perf_counter() - began < 60


def test_even_buckets(spark):
    from corpusloom.operators.catalogue import even_buckets, positions

    values = [None, *range(100), *(10**12 + i for i in range(100)), *[5] * 50]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(3)
    got = {r.i: r.position for r in positions(df, even_buckets(df, "v", 16), "v", "i").collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert df.select(even_buckets(df, "v", 16).alias("b")).groupBy("b").count().agg({"count": "max"}).first()[0] < 80
    assert positions(df.limit(0), even_buckets(df.limit(0), "v"), "v").count() == 0
