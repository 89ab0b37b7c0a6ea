import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from compare import DATA
from corpusloom.llm import chat, quality
from corpusloom.llm.templates import TemplateError, compile_template, escape_control, unescape_control


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_templates():
    render = compile_template("{% set a = 'x' ~ 1 %}{% for m in ms %}{% if loop.first %}<{% elif m.r == 'b' %}|{% else %}:{% endif %}{{ m.t | upper }}{% generation %}{{ a }}{% endgeneration %}{% endfor %}")
    assert render({"ms": [{"r": "a", "t": "q"}, {"r": "b", "t": "w"}, {"r": "c", "t": "e"}]}) == ("<Qx1|Wx1:Ex1", [(2, 4), (6, 8), (10, 12)])
    for bad in ("{% for x %}", "{{ x | nothing }}", "{% if a %}", "{{ x( }}", "{{ x.__class__ }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    assert compile_template("{{ x.y }}{{ x['z'] }}")({"x": {"y": 2}})[0] == "2"


@pytest.mark.parametrize("text", ["", "<|im_end|>", "\\", "\\<|", "<\\|", "a\\\\<||>", "<<|<|"])
def test_escapes_are_reversible(text):
    assert unescape_control(escape_control(text)) == text
    assert "<|" not in escape_control(text)


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b\nc"), (1, 1, "user", "<|im_end|>"), (2, 1, None, None), (3, 1, "assistant", "é" * 5000), (3, 1, "assistant", "é" * 5000), (None, 1, "user\n", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = Counter()
    for key in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == key))
        said = "".join(x for _, r, x in turns if r == "assistant")
        want[key, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said)] += 1
    whole = chat.read_back(chat.format_conversations(df)).collect()
    assert Counter(tuple(r)[:5] for r in whole) == want
    for block in (1, 5001):  # a block per turn; blocks of one and of two long turns
        assert Counter(chat.read_back(chat.format_conversations(df, block=block)).collect()) == Counter(whole)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_a_long_conversation_is_many_blocks(spark):
    df = spark.range(3000).selectExpr("id % 3 * 0 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('<|im_end|>', repeat('ab ', 40), id) as text")
    formatted = chat.format_conversations(df, block=10_000)
    blocks = sorted((r.block, r.n_turns, len(r.formatted)) for r in formatted.collect())
    assert [b for b, _, _ in blocks] == list(range(len(blocks))) and len(blocks) > 30
    assert sum(n for _, n, _ in blocks) == 3000 and max(size for _, _, size in blocks) < 20_000
    assert chat.read_back(formatted).collect() == chat.read_back(chat.format_conversations(df)).collect()


LOOPS = [
    "{% for m in messages %}{% if loop.first %}<s>{% endif %}{{ loop.index }}{{ m.text }};{% if loop.last %}</s>{% endif %}{% endfor %}",
    "{% set a = 'x' %}head {{ a }} {% for m in messages %}{{ a }}{% generation %}{{ m.text }}{% endgeneration %}{{ loop.index0 }}{% endfor %} tail{% generation %}!{% endgeneration %}",
    "{% for m in messages %}{% for n in messages %}{{ n.role }}{% endfor %}{% endfor %}",  # needs the whole
    "{{ messages | length }}{% for m in messages %}{{ m.text }}{% endfor %}",
    "{% for m in messages %}{{ m.text }}{% endfor %}{% for m in messages %}{{ m.role }}{% endfor %}",
    "nothing of them",
]


@pytest.mark.parametrize("template", LOOPS)
def test_blocks_say_what_the_whole_does(spark, template):
    rows = [(c, t, f"r{t}", "é" * (7 * t % 11)) for c in range(4) for t in range(1 + 5 * c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (1, 9, 1 << 20):
        formatted = chat.format_conversations(df, template=template, block=block).orderBy("conv_id", "block").collect()
        for c in range(4):
            mine = [r for r in formatted if r.conv_id == c]
            text, spans = compile_template(template)({"messages": [{"role": r, "text": x} for d, _, r, x in rows if d == c]})
            assert "".join(r.formatted for r in mine) == text and sum(r.n_turns for r in mine) == 1 + 5 * c
            before = [sum(len(r.formatted) for r in mine[:i]) for i in range(len(mine))]
            assert [(b + s.start, b + s.end) for r, b in zip(mine, before) for s in r.loss] == spans
    many = len({r.block for r in chat.format_conversations(df, template=template, block=1).collect()})
    assert many > 5 if template in LOOPS[:2] else many == 1


def measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)})


def test_quality_counts(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *(m := measures(r.text)), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in rows)
    found = quality.judged(docs).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in found) == want
    assert not any(r.kept and r.base_failed for r in found)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in found if r.kept)
    assert quality.judged(no_docs).count() == 0


def test_quality_fences_adapt(spark):
    rows = [(i, "plain words only in this text of ten or more words " + str(i), "en", "a") for i in range(40)]
    rows += [(100 + i, "# $ % " * 5 + "symbols are the rule in this source and nobody minds " + str(i), "en", "b") for i in range(40)]
    rows.append((999, "# $ % " * 5 + "but symbols are rare in the first source so this goes 999", "en", "a"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.judged(df).collect() if not r.kept} == {999} | {r[0] for r in rows if measures(r[1])[4] * 5 > measures(r[1])[0]}


def test_small_and_polluted_groups_take_the_fence_above(spark):
    signs = lambda n: " ".join(f"w{i}#$%" for i in range(n))
    spam = signs(20) + " symbols in a row where nobody uses any of them, number "
    rows = [(i, "plain words only in this text of ten or more words " + str(i), "en", "large") for i in range(60)]
    rows += [(100, spam + "100", "en", "small"), (101, "plain words only in this text of ten or more words 101", "en", "small")]
    rows += [(200, spam + "200", "xx", "small"), (201, "plain words only in this text of ten or more words 201", "xx", None)]
    # In a polluted group the quartiles are so far apart that its own fence is beyond any share.
    rows += [(300 + i, (signs(40) if i % 2 else "") + f" words of a source where half of the texts is filled with signs {i}", "en", "polluted") for i in range(40)]
    found = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if not r.base_failed}
    assert not found[100] and found[101] and not found[200] and found[201]
    assert not any(kept for i, kept in found.items() if i >= 300 and i % 2) and all(found[i] for i in range(60))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
        assert docs.columns == columns
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.decoded for r in out.collect()} == kept
    assert 0.5 * n < len(kept) < n


def test_pipeline_on_hard_texts(spark, docs, no_docs, tmp_path):
    """Nulls, empty and very long texts, copies, repeated rows, clashing columns; and an empty table."""
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, table in (("some", docs), ("none", no_docs)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == table.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        texts = {r.doc_id: r.text for r in kept.collect()}
        assert {r.doc_id: r.decoded for r in out.collect()} == texts
        assert len(texts) == kept.count()
        if name == "none":
            assert not texts
        else:
            assert None not in texts.values() and "" not in texts.values()
            before = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
            long = max((t for t in before.values() if t), key=len)
            assert any(t == long for t in texts.values())  # a long text that repeats nothing stays whole
