import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rules, search, segments
from corpusloom.sources.versions import Conflict, Versions, delete, put, replace_all

FIELDS = {"title": 2.0, "body": 1.0}


def test_replace_all_or_nothing(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([(i, f"r{i}") for i in range(100)], "id long, name string")
    fault = rules.first_violation(rules.longer("name", 10))
    saved = replace_all(store, old, fault, key="id")
    assert (saved.version, saved.written, saved.failed, saved.removed) == (1, 100, 0, 0)
    pinned = store.open("records")
    killed = F.udf(lambda i: 1 // (77 - i), "long")  # fails in one task, after others have written
    with pytest.raises(Exception, match="ZeroDivision"):
        replace_all(store, old.repartition(4).withColumn("id", killed("id") * 0 + F.col("id")), fault, key="id")
    assert store.current() == 1 and store.open("records").count() == 100
    faulty = replace_all(store, old.withColumn("name", F.when(F.col("id") == 5, "much too long a name").otherwise(F.col("name"))), fault, key="id")
    assert faulty.version is None and faulty.failed == 1 and [r.id for r in faulty.failures.collect()] == [5]
    assert store.current() == 1 and len(store.log._names("data")) == 1
    saved = replace_all(store, old.where("id < 40"), fault, key="id")
    assert (saved.version, saved.written, saved.removed) == (2, 40, 60)
    assert pinned.count() == 100 and store.open("records").count() == 40 and store.open("records", 1).count() == 100
    with pytest.raises(Conflict):
        replace_all(store, old, fault, key="id", based_on=1)  # made from a version that is no longer the newest
    assert store.current() == 2
    (tmp_path / "store/data/0000000003-lost").mkdir()
    assert len(store.vacuum(1, older_than=0)) == 2 and store.open("records").count() == 40 and store.log.numbers() == [2]


def test_single_writes_and_deletes(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(r, "file string, xml string")
    assert put(store, rows(("a", "1"), ("b", "1"), (None, "0")), key="file") == 1
    assert put(store, rows(("b", "2"), ("c", "2"), (None, "2")), key="file") == 2
    held = lambda: sorted(map(tuple, store.open("records").collect()), key=repr)
    assert held() == sorted([("a", "1"), ("b", "2"), ("c", "2"), (None, "0"), (None, "2")], key=repr)
    assert delete(store, rows(("a", ""), ("z", "")), key="file") == 2 and len(held()) == 5  # not enabled
    assert delete(store, rows(("a", ""), ("z", "")), key="file", enabled=True) == 3 and ("a", "1") not in held() and len(held()) == 4
    with pytest.raises(Conflict):
        put(store, rows(("d", "3")), key="file", based_on=2)


def texts(rng, n):
    word = lambda: "".join(rng.choices("aeo tn", k=5)).strip() or "é"
    return [(i, " ".join(word() for _ in range(3)), " ".join(word() for _ in range(rng.randint(0, 20)))) for i in range(n)]


def found(index, query, **how):
    return {(r.id, round(r.score, 9), r.n_words) for r in search.search(index, query, **how).collect()}


def test_follows_its_table(spark, tmp_path):
    rng = random.Random(8)
    schema = "id long, title string, body string"
    rows = [*texts(rng, 60), (None, "a null id", "tea"), (900, None, None), (901, "", "—")]
    index = segments.SegmentIndex(spark, str(tmp_path / "index"), FIELDS)
    assert found(index.open(), "tea") == set()
    assert index.update(spark.createDataFrame(rows, schema)) == {"added": 63, "changed": 0, "deleted": 0}
    assert index.update(spark.createDataFrame(rows, schema)) == {"added": 0, "changed": 0, "deleted": 0}
    first = index.open()
    queries = [("tea ante", {}), ("not eta", {"every": True}), ("tae", {"prefix": False, "fuzzy": 0})]
    before = [found(first, q, **how) for q, how in queries]
    for step in range(6):
        state = {r[0]: r for r in rows}
        for i in rng.sample(list(state), 5):
            del state[i]
        for i in rng.sample(list(state), 4):
            state[i] = (i, f"tea {step}", "ante")
        for i in range(3):
            state[1000 + 10 * step + i] = (1000 + 10 * step + i, "tea not", None if i else "eta")
        rows = list(state.values())
        report = index.update(spark.createDataFrame(rows, schema).repartition(3))
        assert report["deleted"] == 5 and report["added"] == 3
        if step % 2:
            index.compact(2)
        anew = search.index_of(search.postings(spark.createDataFrame(rows, schema), FIELDS))
        for q, how in queries:
            assert found(index.open(), q, **how) == found(anew, q, **how)
    assert [found(first, q, **how) for q, how in queries] == before  # pinned
    _, state = index.state()
    assert len(state["segments"]) < 7
    index.update(spark.createDataFrame([(5000, "tea", "tea")], schema), whole=False)  # rows that are not all there are
    assert index.documents(index.state()[1], "bigint").count() == len(rows) + 1
    held = found(index.open(), "tea ante")
    assert index.vacuum(older_than=3600) == [] and index.vacuum(1, older_than=0) and found(index.open(), "tea ante") == held
    index.update(spark.createDataFrame([], schema))
    assert found(index.open(), "tea") == set() and index.state()[1]["total"] == 0


def test_only_changes_are_tokenised(spark, tmp_path):
    rows = spark.createDataFrame(texts(random.Random(1), 200), "id long, title string, body string")
    index = segments.SegmentIndex(spark, str(tmp_path / "index"), FIELDS)
    index.update(rows)
    index.update(rows.withColumn("body", F.when(F.col("id") == 17, "tea").otherwise(F.col("body"))))
    _, state = index.state()
    assert Counter(state["segments"].values()) == Counter([200, 1])
    new = next(n for n, size in state["segments"].items() if size == 1)
    assert {r.id for r in index._read([new], "postings", "").collect()} == {17}


def test_two_writers(spark, tmp_path, monkeypatch):
    base, schema = str(tmp_path / "index"), "id long, title string, body string"
    one, other = (segments.SegmentIndex(spark, base, FIELDS) for _ in range(2))
    plain, tries = one.log.commit, []

    def late(based_on, content):
        if not tries:
            tries.append(other.update(spark.createDataFrame([(1, "tea", "")], schema), whole=False))
        return plain(based_on, content)

    monkeypatch.setattr(one.log, "commit", late)
    one.update(spark.createDataFrame([(2, "tea", "")], schema), whole=False)
    assert {i for i, _, _ in found(one.open(), "tea")} == {1, 2}


def test_common_terms_are_not_in_one_task(spark, tmp_path):
    """What all documents say lies in all files of the postings, each sorted by term."""
    rows = spark.range(4000).select("id", F.concat(F.lit("tea for "), F.col("id").cast("string")).alias("title"), F.repeat(F.lit("tea leaf "), 70).alias("body"))
    index = segments.SegmentIndex(spark, str(tmp_path / "index"), FIELDS)
    index.update(rows)
    name = next(iter(index.state()[1]["segments"]))
    held = index._read([name], "postings", "").withColumn("file", F.col("_metadata.file_name"))
    per_file = [r.n for r in held.where("term = 'tea'").groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert sum(per_file) == 8000 and len(per_file) > 2 and max(per_file) < 4000
    for (file,) in held.select("file").distinct().collect():
        terms = [r.term for r in spark.read.parquet(index._path(name, "postings", file)).select("term").collect()]
        assert terms == sorted(terms)


def test_many_terms_leave_the_postings_where_they_are(spark, tmp_path, monkeypatch):
    """A prefix of more terms than are pushed, and many queries at once, send their words to the postings; without that the results are the same."""
    rows = spark.range(1500).select("id", F.concat(F.lit("tea"), F.col("id").cast("string")).alias("title"), F.lit("tea leaf").alias("body"))
    index = segments.SegmentIndex(spark, str(tmp_path / "index"), FIELDS)
    index.update(rows)
    asked = spark.range(300).select(F.concat(F.lit("#tea"), (F.col("id") * 2).cast("string"), F.lit(" leaf")).alias("q"))
    hits = lambda: [search.search(index.open(), "tea leaf", fuzzy=0), search.search_many(index.open(), asked, "q", "q")]
    held = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    sent = hits()
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in sent]
    assert not any("SortMergeJoin" in p for p in plans)
    got = [held(df) for df in sent]
    monkeypatch.setattr(search, "SENT", 1)
    assert [held(df) for df in hits()] == got and len(got[0]) == 1500 and len(got[1]) == 300 * 1500
