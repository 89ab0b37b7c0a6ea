from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import diff, markup, text
from corpusloom.operators import catalogue, derive, mutate, records, rules, search, statistics, timeline
from corpusloom.operators import markup as markup_ops
from corpusloom.sources import corpus
from corpusloom.streaming import changes


@pytest.mark.parametrize(
    "edition, shown, ranges",
    [
        ('<ab><lb n="1"/>abc <supplied reason="lost">def</supplied>gh<lb n="2" break="no"/>ij <gap reason="lost" extent="unknown" unit="character"/> kl</ab>', "abc defghij […] kl", [(4, 7)]),
        ('<ab>\n  <lb n="1"/>abc de\n  <lb n="2" break="no"/>fg</ab>', "abc de fg", []),
        ('<ab><lb n="1"/>x <choice><sic>qq</sic><corr>yy</corr></choice>z</ab>', "x yyz", []),
        ('<ab><lb n="1"/>ab<lb n="2"/>cd <supplied reason="lost">e<supplied>f</supplied></supplied> g</ab>', "ab cd ef g", [(6, 8)]),
        ("<ab>un<b>closed</ab>", "unclosed", []),
        ("a<gap/>b<supplied> c</supplied>", "a […] b c", [(7, 9)]),
        (None, "", []),
    ],
)
def test_running_text(edition, shown, ranges):
    assert markup.linearise(edition) == (shown, ranges)


def test_tokens():
    source = '<p a="1" b=""><lb/>x<b>y</b></p>z'
    error, found = markup.tokenize(source)
    assert error is None and [t[0] for t in found] == [[0], [0, 0], [0, 1], [0, 2], [0, 2, 0], [1]]
    assert markup.serialize(markup.tree(source)) == source.replace(' b=""', "")
    again = markup.serialize(markup.tree(source))
    assert markup.serialize(markup.tree(again)) == again
    for bad in ("<a>", "</a>", "<a><b></a></b>", "a < b"):
        assert markup.tokenize(bad)[0] and markup.tokenize(bad)[1] == []
    assert markup.leiden('a<supplied reason="lost">b</supplied><gap quantity="2"/><gap/><space/>') == "a[b][··][---]vac."


def test_dates_and_labels(spark):
    df = spark.createDataFrame([(-600, -400), (0, 600), (None, 600), (None, None), (100, 200), (-50, 50), (0, 0), (100, 100), (None, 120), (-100, -50)], "s int, e int")
    out = df.select(
        catalogue.date_contained(F.col("s"), F.col("e"), -500, 500).alias("c"), catalogue.date_overlapping(F.col("s"), F.col("e"), -500, 500).alias("m"), text.range_label(F.col("s"), F.col("e")).alias("l")
    ).collect()
    assert [(r.c, r.m) for r in out[:5]] == [(False, True), (True, True), (True, False), (True, True), (True, True)]
    assert [r.l for r in out[5:]] == ["50 a.C. - 50 d.C.", "-", "100 d.C.", "120 d.C.", "100 a.C. - 50 a.C."]
    years = spark.createDataFrame([(-25,), (-4,), (5,), (14,), (15,)], "y int").withColumn("id", F.monotonically_increasing_id())
    assert {(r.bucket, r.n) for r in timeline.buckets(years, year="y").collect()} == {(-20, 1), (0, 1), (10, 2), (20, 1)}
    assert tuple(timeline.domain(years, start="y", end="y").collect()[0]) == (-200, 200)
    assert tuple(timeline.domain(years.limit(0), start="y", end="y").collect()[0]) == (-400, 400)


def test_lanes(spark):
    items = [("a", 1, 0, 10), ("a", 2, 5, 8), ("a", 3, 9, 12), ("a", 4, 11, 12), ("b", 5, 0, 1)]
    got = {r.id: r.lane for r in timeline.lanes(spark.createDataFrame(items, "g string, id long, low long, high long"), "g").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_pmi(spark):
    r = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (2, "a")], "record int, value string")
    c = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Y"), (4, "Y")], "record int, value string")
    out = {(x.row_value, x.col_value): (x.n, x.pmi, x.reading) for x in statistics.cooccurrence(r, c, 4).collect()}
    assert out == {("a", "X"): (2, 1.0, "low"), ("b", "X"): (1, 0.0, "low"), ("b", "Y"): (1, 0.0, "low")}


def test_merges(spark):
    schema = "k string, ord long, v string, file string"
    old = spark.createDataFrame([("A", 1, "a", "fa"), ("B", 2, "b", "fb")], schema)
    new = spark.createDataFrame([("B", 3, "b2", "x"), ("C", 4, "c1", "x"), ("C", 5, "c2", "y")], schema)
    values = lambda df: sorted(r.v for r in df.collect())
    assert values(mutate.merge_overwrite(old, new)) == ["b2", "c1", "c2"]
    appended = mutate.merge_append(old, new, "k", "ord")
    assert values(appended) == ["a", "b", "b2", "c1", "c2"] and appended.select("k").distinct().count() == 5
    assert values(mutate.merge_skip(old, new, "k", "ord")) == ["a", "b", "c1"]
    replaced = mutate.merge_replace(old, new, "k", "ord", keep=("file",))
    assert values(replaced) == ["a", "b2", "c1", "c2"]
    assert {r.file for r in replaced.where("v = 'b2'").collect()} == {"fb"}


def test_ledger_and_mirror(spark):
    rows = [("E1", "", "resolved", "2026-01-02", "2026-01-05", "n1"), ("E1", "", "open", "2026-01-01", None, "n2"), ("E2", "two", "resolved", "2026-01-03", "2026-01-04", "n3")]
    df = spark.createDataFrame(rows, "e string, label string, status string, created string, resolved string, note string")
    out = {r.e: r for r in mutate.ledger(df, "e", label="label", status="status", created="created", resolved="resolved", note="note").collect()}
    assert tuple(out["E1"])[1:] == ("open", "2026-01-01", None, "E1", 2, "n2\nn1")
    assert tuple(out["E2"])[1:] == ("resolved", "2026-01-03", "2026-01-04", "two", 1, "n3")
    files = lambda *x: spark.createDataFrame([(f,) for f in x], "file string")
    assert [r.file for r in mutate.mirror_deletes(files("a", "b", "c"), files("a"), files("b"), confirmed=True).collect()] == ["c"]
    assert mutate.mirror_deletes(files("a"), files("x"), files("y"), confirmed=False).count() == 0


TEI = """<TEI><teiHeader><titleStmt><title>A <rs type="textType">x</rs> title —</title></titleStmt><idno type="id">12</idno><idno type="TM" ref="http://tm/77">77</idno><idno type="PHI">3</idno>
<supportDesc><support><material ref="m">stone</material><objectType>stele</objectType></support></supportDesc><height unit="cm">10</height><width atLeast="20" atMost="25">x</width>
<layoutDesc><layout><rs type="execution" ref="r">carved</rs><p>See <ptr target="#abc"/> p. 3</p></layout></layoutDesc><handDesc><handNote><p>tall</p></handNote></handDesc>
<origin><origPlace>near <placeName type="ancient" ref="p1">Old &amp; Town</placeName></origPlace>about <origDate notBefore-custom="-0100" notAfter-custom="0050" evidence="letters">1st c.</origDate>, or <origDate when="70">70</origDate></origin>
<geogName type="ancientRegion">North</geogName><provenance type="found"><p>in a field</p></provenance>
<rs type="textType">Senza iscrizione</rs><rs type="textType">Dedica</rs><rs type="textType">Iscrizione greca</rs>
<keywords scheme="epiteti"><term>Soter</term></keywords><keywords scheme="divinita"><term>Zeus Soter</term><term>Aaa Bbb</term></keywords><keywords scheme="onomastica"><term>Ee</term></keywords>
<revisionDesc><change when="2020-01-01" who="#me">made</change></revisionDesc>
<listPerson><person xml:id="p1"><persName key="Dd"><name nymRef="Dn">Di</name></persName><placeName type="ethnic" ref="e1">of X</placeName></person></listPerson>
<xenoData><iconography><function key="votive"/><figure n="1" type="god" key="men" place="top"><trait type="attribute" key="crescent" hand="left"/><trait type="x"/></figure><figure type="symbol" key="sickle"/><figure key="z"/></iconography></xenoData></teiHeader>
<text><body><div type="edition"><ab><lb n="1"/><persName type="divine" key="Aaa Bbb Ccc"><name>x</name><name>y</name></persName>
<persName type="attested" key="Dd">d</persName><persName type="attested">Ff</persName><persName type="divine"><name>Gg</name></persName><persName key="Hh" type="attested">ii</persName><persName type="emperor" key="Kk">k</persName></ab></div>
<div type="apparatus"><app loc="1"><note>n1</note></app><app loc="2"><lem>l</lem><rdg>r1</rdg><rdg>r2</rdg></app></div>
<div type="translation" xml:lang="it"><p>uno</p><p>due</p><note>DA_COMPILARE</note></div><div type="translation" xml:lang="en"><p>DA_COMPILARE</p></div>
<div type="commentary"><p>com <foreign xml:lang="grc">λ</foreign></p></div><div type="bibliography"><bibl>Smith 1990 <citedRange>p. 4</citedRange></bibl><bibl>Jones</bibl></div></body></text></TEI>"""


def test_record_extraction(spark):
    df = spark.createDataFrame([("f.xml", f"<teiCorpus>{TEI}\n{TEI}</teiCorpus>"), ("g.xml", "nothing"), ("h.xml", '<TEI><height unit="cm">10</height><width atLeast="20" atMost="25">x</width></TEI>')], "file string, xml string")
    rows = records.extract(records.split_records(df), keep=("file", "part")).collect()
    assert [(r.file, r.part) for r in rows] == [("f.xml", 0), ("f.xml", 1), ("h.xml", 0)]
    r = rows[0]
    assert (r.id, r.entryId, r.tm, r.tmLink, r.phi, r.titolo, r.materiale, r.materialRef, r.tipo) == (12, None, "77", "http://tm/77", ["3"], "A title", "stone", "m", "stele")
    assert (r.dim, r.layout_desc, r.scrittura, r.scrittura_ref, r.scrittura_note) == ("See abc p. 3", "See abc p. 3", "carved", "r", "tall")  # the first paragraph after support, wherever it stands
    assert (r.citta, r.place_ref_ancient, r.regione, r.origPlace_nota, r.luogo_rit) == ("Old & Town", "p1", "North", "near", "in a field")
    assert (r.data_inizio, r.data_fine, r.data) == (-100, 50, "about 1st c. / or 70")
    assert [(d.prefix, d.notBeforeCustom, d.notAfterCustom) for d in r.origDates] == [("about", "-0100", "0050"), ("or", "70", "70")]
    assert (r.iscrizione, r.anepigr, r.textTypes) == (True, True, ["x", "Senza iscrizione", "Dedica"])
    assert (r.divinita, r.epiteti) == (["Aaa Bbb", "Gg", "Zeus"], ["Soter", "Ccc"])
    assert [(d.divinita, d.epiteti) for d in r.divinitaEpiteti] == [("Aaa Bbb", ["Ccc"]), ("Gg", []), ("Zeus", ["Soter"])]
    assert (r.onomastica, r.imperatori) == (["Dd", "Ff", "ii", "Ee"], ["Kk"])
    assert tuple(r.persone[0]) == ("p1", "Dd", "Dn", "Di", "e1", None, "of X", None)
    assert [tuple(x) for x in r.apparatus_entries] == [("1", "n1"), ("2", "l | r1 | r2")] and r.apparatus_text == ""
    assert [tuple(x) for x in r.traduzioni] == [("it", "uno\ndue", ""), ("en", "", "")]
    assert (r.note_interne, [(b.titolo, b.citedRanges) for b in r.bibliografia]) == ("com «λ»", [("Smith 1990 p. 4", ["p. 4"]), ("Jones", [])])
    ico = r.iconografia
    assert ico.function == "votive" and [(f.n, f.key, f.place, [(t.key, t.hand) for t in f.traits]) for f in ico.figures] == [(1, "men", "top", [("crescent", "left")]), (1, "sickle", None, [])]
    assert [tuple(x) for x in r.revisions] == [("2020-01-01", "#me", "made")]
    empty = rows[2]
    assert empty.dim == "10 x 20-25 x  cm"
    assert (empty.id, empty.titolo, empty.data_inizio, empty.iconografia, empty.divinita, empty.testo) == (0, "", None, None, [], "")


def test_records_are_read_as_written(spark):
    read = records.extract(records.split_records(spark.createDataFrame([(TEI,)], "xml string")))
    again = records.extract(records.split_records(records.to_xml(read).select(F.concat("tei").alias("xml"))))
    was, now = read.collect()[0].asDict(recursive=True), again.collect()[0].asDict(recursive=True)
    for n, figure in enumerate(was["iconografia"]["figures"], 1):
        figure["n"] = n  # figures are numbered by place when they are written
    assert {k for k in was if was[k] != now[k]} == set()
    assert [f.key for f in again.collect()[0].iconografia.figures] == ["men", "sickle"]
    shown = records.with_searchable(read).collect()[0]
    assert shown.testo_searchable.startswith("xy d") and shown.supplied_ranges == []


def test_written_prose_and_defaults(spark):
    tei = """<TEI><titleStmt><title>T &amp; U</title></titleStmt><dimensions><height>10</height></dimensions><material>stone</material>
    <rs type="textType">Iscrizione greca</rs><keywords scheme="divinita"><term>Zeus Soter Hypsistos</term></keywords><listPerson><person xml:id="a"><persName><name>N &lt; M</name></persName><note>n</note></person></listPerson>
    <body><div type="edition"><ab>x</ab></div><div type="apparatus"><p>nothing to say here</p></div><div type="translation" xml:lang="en"><p>one</p><note>of it</note></div>
    <div type="bibliography">Long prose, see <bibl>Smith</bibl>.</div></body></TEI>"""
    read = records.extract(records.split_records(spark.createDataFrame([(tei,)], "xml string")))
    again = records.extract(records.split_records(records.to_xml(read).select(F.col("tei").alias("xml"))))
    was, now = read.collect()[0].asDict(recursive=True), again.collect()[0].asDict(recursive=True)
    assert {k for k in was if was[k] != now[k]} == set()
    assert was["iscrizione"] and was["dim_unita"] == "metre" and was["apparatus_text"] == "nothing to say here" and len(was["bibliografia"]) == 1
    assert was["divinitaEpiteti"] == [{"divinita": "Zeus", "epiteti": ["Soter", "Hypsistos"]}]


def test_names_and_rules(spark):
    df = spark.createDataFrame([(7, "Ártemis  Ὀρθία!"), (1234, "—"), (50, "x" * 200)], "n int, t string")
    assert [tuple(r) for r in df.select(text.file_name(F.col("n")), F.length(text.entry_id(F.col("t")))).collect()] == [("007.xml", 7), ("1234.xml", 5), ("050.xml", 128)]
    assert spark.range(1).select(text.unescape_xml(F.lit("&amp;lt;")), text.unescape_xml(F.lit("&amp;lt;"), ampersand_first=False)).collect()[0][:] == ("<", "&lt;")
    notes = spark.createDataFrame([("", "a", "open"), ("x", "a" * 101, "open"), ("x", "a", "odd"), ("x" * 4001, "a", None), ("x", None, None)], "testo string, author string, status string")
    got = [r[0] for r in notes.select(rules.note_rules("testo", "author", "status")).collect()]
    assert got == ["testo empty", "author longer than 100", "status unknown", "testo longer than 4000", None]


def test_spans_and_search(spark):
    row = spark.createDataFrame([("abc defghij […] kl", [(4, 7)])], "t string, r array<struct<s:int,e:int>>")
    for needle, want in (("defg", True), ("abc", False), ("ghij", False), ("fghi", True)):
        assert row.withColumn("q", F.lit(needle)).select(search.falls_in_span("q", "r", "t")).collect()[0][0] is want
    docs = spark.createDataFrame([(1, "Ἄρτεμις καλή"), (2, "artemis temple"), (3, "temples, of stone")], "id long, titolo string")
    index = search.index_of(search.postings(docs, {"titolo": 3.0}))
    ids = lambda q, **k: {r.id for r in search.search(index, q, **k).collect()}
    assert ids("αρτεμις") == {1} and ids("temple") == {2, 3} and ids("temple", prefix=False, fuzzy=0) == {2}
    assert ids("artemis temple", every=True) == {2} and ids("artemiz stone", prefix=False) == {2, 3} and ids("  ") == set()


def test_indexed_fields(spark):
    read = records.with_searchable(records.extract(records.split_records(spark.createDataFrame([(TEI,)], "xml string"))))
    row = search.indexed_texts(read, {"votive": "votivo"}).collect()[0]
    assert list(row.asDict()) == ["id", *search.FIELD_BOOST] and len(search.FIELD_BOOST) == 15
    assert (row.apparatus, row.traduzioni, row.bibliografia) == ("n1 l | r1 | r2", "uno\ndue   ", "Smith 1990 p. 4 Jones")
    assert row.iconografia == "votive votivo men crescent sickle" and row.divinita == "Aaa Bbb Gg Zeus"


def test_sources(spark, tmp_path):
    for name, body in (("a.xml", TEI), ("_b.xml", TEI), ("c.xml", "<bad"), ("d.txt", "x")):
        (tmp_path / name).write_text(body)
    docs = corpus.raw_docs(spark, str(tmp_path))
    assert {r.file for r in docs.collect()} == {"a.xml", "c.xml"}
    assert records.split_records(docs).count() == 1
    assert {(r.file, r["size"]) for r in corpus.listing(spark, str(tmp_path)).collect()} == {("a.xml", len(TEI.encode())), ("c.xml", 4)}
    assert corpus.named_file(docs, "a.xml").count() == 1
    (tmp_path / "s.json").write_text('{"generatedAt": "now",\n "files": {"x.xml": "<TEI/>", "y.xml": "z"}}')
    assert {tuple(r) for r in corpus.snapshot(spark, str(tmp_path / "s.json")).collect()} == {("x.xml", "<TEI/>"), ("y.xml", "z")}


def test_bursts_as_a_stream(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("u", at(0)), ("u", at(5)), ("u", at(20)), ("v", at(1))], "user string, ts timestamp")
    want = {(r.user, r.n) for r in changes.bursts(rows, "user", "ts").collect()}
    assert want == {("u", 2), ("u", 1), ("v", 1)}
    rows.write.parquet(str(tmp_path / "in"))
    stream = changes.bursts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user", "ts", late="1 minute")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user, r.n) for r in spark.table("bursts").collect()} == want


def test_derived_from_an_edition(spark):
    edition = '<ab><persName type="divine" key="Men"><name>Μήν</name></persName> <persName type="attested" xml:id="a1">Δίων <persName type="attested" key="Zenon">Ζήνωνος</persName></persName><persName type="ruler" key="R"/><persName xml:id="a1" key="later"/></ab>'
    tokens = markup_ops.tokens(spark.createDataFrame([(1, edition)], "id long, xml string"), "id", "xml")
    found = {(r["index"], r.value) for r in derive.index_suggestions(tokens, "id").collect()}
    assert found == {("divinita", "Men"), ("onomastica", "Δίων Ζήνωνος"), ("onomastica", "Zenon"), ("imperatori", "R")}
    assert [tuple(r) for r in derive.edition_persons(tokens, "id").collect()] in ([(1, "a1", None)], [(1, "a1", "later")])


def test_edition_trees():
    assert markup.edition_tree("one\n two ") == [("lb", {"n": "1"}, [], True), "one", ("lb", {"n": "2"}, [], True), "two"]
    assert markup.edition_tree("") == [("lb", {"n": "1"}, [], True)]
    nodes = markup.edition_tree('<div><ab>\n <lb n="7" break="no"/> a \n b<lb/>c <w>d\n</w> </ab></div>')
    assert markup.serialize(markup.renumbered(nodes)) == '<lb n="1"/>a b<lb n="2"/>c <w>d</w>'
    assert markup.shown_text(markup.tree("<choice><sic>x</sic><corr>y</corr></choice><lb/><expan><abbr>a</abbr><ex>b</ex></expan><subst><del>p</del><add>q</add></subst>")) == "y aq"
    assert diff.counts("a\nb\nc\nd", "b\nx\nd\na") == (2, 2, 2) and diff.counts(None, "") == (0, 0, 1)


def test_labels(spark):
    df = spark.createDataFrame([(1, "T", "C", "R"), (2, "", "C", None), (3, None, "", "R"), (None, None, None, None)], "id long, titolo string, citta string, regione string")
    rows = df.select(text.record_label(F.col("id"), "N"), text.place_name(), text.shown_title()).collect()
    assert [tuple(r) for r in rows] == [("N 1", "C, R", "T"), ("N 2", "C", "C"), ("N 3", "R", "R"), ("N ?", "N/A", None)]
    names = spark.createDataFrame([("XX-AB-012_nr3.xml",), ("other",)], "f string").select(text.draft_label(F.col("f"), "XX")).collect()
    assert [r[0] for r in names] == ["AB 12", "other"]
    figure = ("god", "men", [("held", "patera")])
    ico = spark.createDataFrame([(("votive", [figure], "note"),), (None,)], "i struct<function:string,figures:array<struct<type:string,key:string,traits:array<struct<type:string,key:string>>>>,note:string>")
    assert [r[0] for r in ico.select(text.iconography_text("i", {"men": "Mese", "god": "dio"})).collect()] == ["votive men Mese dio patera note", ""]
    assert spark.range(1).select(text.translated(F.lit("men"), {"men": "mese"}), text.translated(F.lit("luna"), {})).collect()[0][:] == ("Mese", "Luna")


def test_reports_axes_and_filters(spark):
    rows = [(1, "Roma", "A", ["Zeus", "zeus"], ["X"], "a"), (2, "roma", "A", ["Zeus"], ["Y", "Y"], None), (3, "", "B", None, [], "b")]
    df = spark.createDataFrame(rows, "id long, citta string, regione string, divinita array<string>, epiteti array<string>, function string")
    found = {(r.report, r.key): (r.n_variants, r.variants, r.n_uses) for r in statistics.variant_reports(df, text.fold, ("divinita", "citta", "epiteti")).collect()}
    assert found == {("divinita", "zeus"): (2, "Zeus|zeus", 3), ("citta", "roma"): (2, "Roma|roma", 2)}
    assert {(r.report, r.n) for r in statistics.conflicts(statistics.variant_reports(df, text.fold, ("divinita", "citta"))).collect()} == {("divinita", 1), ("citta", 1), (None, 2)}
    kept = catalogue.CatalogueQuery(regioni=("A", "C"), epiteti=("Y", "Z"), dates=None).apply(df)
    assert [r.id for r in kept.collect()] == [2]
    axes = [[list(r[0]) for r in df.select(statistics.axis(a)).collect()] for a in ("divinita", "citta", "epiteti")]
    assert axes == [[["Zeus", "zeus"], ["Zeus"], []], [["Roma"], ["roma"], []], [["X"], ["Y"], []]]
    chips = spark.createDataFrame([("alpha",), ("Beta alp",), ("gamma",)], "label string")
    assert [r.label for r in catalogue.completions(chips, "label", "ALP", F.array(F.lit("alpha"))).collect()] == ["Beta alp"]
    notes = spark.createDataFrame([("E", "open", "1", None), ("F", "resolved", "1", "2")], "e string, status string, created string, resolved string")
    later = mutate.status_set(notes, "e", spark.createDataFrame([("E", "resolved", "9")], "e string, status string, at string"))
    assert {tuple(r) for r in later.collect()} == {("E", "resolved", "1", "9"), ("F", "resolved", "1", "2")}
    again = mutate.note_appended(notes, spark.createDataFrame([("F", "3")], "e string, created string"))
    assert ("F", "open", "3", None) in {tuple(r) for r in again.collect()}
    with pytest.raises(ValueError):
        rules.within_batch(spark.range(501))


def test_ledger_meets_one_record(spark):
    entries = spark.createDataFrame([("a",), ("7",), ("z",)], "entryId string")
    records_ = spark.createDataFrame([("a", 5), ("a", 3), ("b", 7), ("b2", 7)], "entryId string, id long")
    assert {(r.entryId, r.record_id) for r in mutate.ledger_of_record(entries, records_).collect()} == {("a", 3), ("7", 7), ("z", None)}


def test_loose_records(spark):
    df = spark.createDataFrame([("<x><TEI\n a='1'>one</TEI></x>",), ("<TEI>a</TEI><TEI>b</TEI>",), ("<TEIx>y</TEI>",)], "xml string")
    assert [r.tei for r in records.split_records(df).collect()] == ["<TEI\n a='1'>one</TEI>", "<TEI>a</TEI>", "<TEI>b</TEI>", "<TEIx>y</TEI>"]


def test_line_breaks(spark):
    df = markup_ops.tokens(spark.createDataFrame([(1, '<lb/><w>a<lb n="5" break="no"/></w>')], "id long, x string"), "id", "x")
    assert [tuple(r) for r in markup_ops.line_breaks(df, "id").collect()] == [(1, 1, [0], False, True), (1, 2, [1, 1], True, False)]
