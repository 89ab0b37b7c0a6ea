import re
from collections import Counter

from corpusloom.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, u in items:
            v = words(u)
            size = min(10, len(v))
            windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found.add(str(i)) if i is not None else None
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def test_against_every_window(spark, docs, texts):
    long = texts[-1 - 40 - 1]
    items = [(1, " ".join(long.split()[100:130])), (2, "THE cat, sat!"), (10, texts[13]), (10, texts[13]), (3, ""), (4, None), (None, "spam " * 12), (5, "absent words")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, items)
    for most in (decontaminate.BLOCK_WORDS, 30):  # the second reads the benchmark in several blocks
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contaminated(docs, table, block_words=most).collect())
        assert got == want
        clean = decontaminate.uncontaminated(docs, table, block_words=most)
        assert clean.columns == docs.columns
        assert Counter(r.doc_id for r in clean.collect()) == Counter({d: n for (d, _, h, _), n in want.items() if not h})


def test_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(no_docs, none).count() == 0
    assert decontaminate.contaminated(docs, none).where("n_hit > 0").count() == 0
