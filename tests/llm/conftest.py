import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, fp string, g string, row string, spans string, k_id long, bad_id long, __fp string"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


def hard_texts():
    """Nulls, empty and very long texts, ties, copies, near copies, shared lines and passages, odd characters."""
    rng = random.Random(3)
    passage, line = words(rng, 120), "all rights reserved by the people of this page"
    out = [None, "", " \t\n", "one", "one", "a b c d", "A B C D e", "the cat sat on the mat", "—…", "x" * 3000, "é" * 700, "\x00 nul \x00", "Σς İ ß"]
    base = words(rng, 200)
    out += [base] * 4
    for i in range(6):  # near copies that chain
        w = base.split()
        w[20 * i : 20 * i + 3] = ["edit", str(i), "here"]
        out.append(" ".join(w))
    out += [f"{words(rng, 40)} {passage} {words(rng, 30)}" for _ in range(5)]
    out += [f"{words(rng, 30)}\n{line}\n{words(rng, 30)}\n{line}" for _ in range(20)]
    out.append(words(rng, 20000))
    out += [words(rng, rng.randint(1, 60)) for _ in range(40)]
    out.append(" ".join(["spam"] * 300))
    return out


@pytest.fixture(scope="session")
def texts():
    return hard_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], "s0" if i % 3 else f"s{i % 5}", len(t or ""), *["clash"] * 5, i, i, "clash") for i, t in enumerate(texts)]
    rows.append(rows[14])  # the same row twice
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
