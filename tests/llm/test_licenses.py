import random
import re

import numpy as np
import pytest
from compare import DATA

from corpusloom.llm import licenses
from corpusloom.llm.queries import op4_license_scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
PROSE = "The river ran past the mill and the children of the village played there until the evening bell."


def found(spark, said, **other):
    rows = [(i, t, "clash", "clash", 1, "clash") for i, t in said.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, line string, fp long, pos string")
    return {r.doc_id: r for r in licenses.scanned(df).collect()}


def test_families_and_the_rest(spark):
    said = {
        1: ("x y z\nThis software is distributed under the GNU GPL v3", "gpl"),
        2: ("Released under the MIT License.\nmore", "mit"),
        3: ("All  RIGHTS reserved.", "proprietary"),
        4: ("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        5: ("He got his driving license in the public library", "none"),
        6: ("mere words about nothing of that kind", "none"),
        7: (None, "none"),
        8: ("\n \n", "none"),
        9: ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd"),
    }
    rows = [(i, t, "clash", "clash", 1) for i, (t, _) in said.items()] + [(3, said[3][0], "clash", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, line string, fp long")
    out = licenses.scanned(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.licence for r in out} == {i: f for i, (_, f) in said.items()}
    by = {r.doc_id: r for r in out}
    assert by[2].confirmed and by[2].n_paragraphs == 1 and by[2].n_licence == 1 and by[8].n_paragraphs == 0
    assert all(0 <= r.score <= 1 for r in out)
    assert licenses.scanned(df.limit(0)).count() == 0


def test_paragraphs_over_lines(spark):
    words = MIT.split()
    rng = random.Random(1)
    long = "\n".join(" ".join(rng.choices(PROSE.split(), k=12)) for _ in range(3000))
    out = found(
        spark,
        {
            1: " ".join(words[:8]) + "\n" + " ".join(words[8:15]) + "\n" + " ".join(words[15:]),  # wrapped
            2: f"{PROSE}\n{PROSE}\n{MIT}\n{PROSE}\n{PROSE}",  # inside a long paragraph
            3: f"{PROSE}\n\nAll rights reserved.\n \n{PROSE}\n\n\nReleased under the MIT License.",  # paragraphs between blank lines
            4: f"{long}\nLicensed under the Apache License, Version 2.0.\n{long}",  # very long
            5: "Released under the MIT License.\n\nReleased under the BSD License.",  # nearly a tie
            6: long,
        },
    )
    assert out[1].licence == "mit" and out[1].confirmed and out[1].n_paragraphs == out[1].n_licence == 1
    assert out[2].licence == "mit" and out[2].n_paragraphs == 1
    assert out[3].n_paragraphs == 4 and out[3].n_licence == 2 and out[3].licences == "mit,proprietary"
    assert out[4].licence == "apache" and out[4].confirmed
    assert out[5].licences == "bsd,mit" and out[5].n_licence == 2
    assert out[6].licence == "none" and out[6].n_paragraphs == 1


def test_recall_by_family_and_unknown(spark):
    """Sentences that nothing was learned from, for every name; and families that aren't among the known ones."""
    said, want = {}, {}
    for family, names in licenses.FAMILIES.items():
        for name in names:
            for s in ("The code in this repository is made available under the {}.", "See LICENSE for the text of the {} which covers this package"):
                i = len(said)
                said[i], want[i] = s.format(name), family
    for name in ("European Union Public Licence 1.2", "Artistic License 2.0", "zlib License", "Eclipse Public License 2.0", "SIL Open Font License 1.1"):
        i = len(said)
        said[i], want[i] = f"This file is licensed under the terms of the {name}.", "unknown"
    out = found(spark, said)
    right: dict[str, list] = {}
    for i, family in want.items():
        right.setdefault(family, []).append(out[i].licence == family)
    recall = {f: float(np.mean(x)) for f, x in right.items()}
    assert min(recall.values()) >= 0.9, recall


def test_no_licence_without_a_trigger():
    for others in ([], ["some other line of all the things that were there", "and one more"], [PROSE] * 50):
        model = licenses.Model(others)
        free = [g for g in model.grams if not set(g.split(" ")) & set(model.triggers)]
        best = np.maximum(model.weights[:-1, :-1] - model.weights[:-1, -1:], 0)[[model.place[g] for g in free]].sum(0)
        assert np.exp(model.weights[-1, :-1] - model.weights[-1, -1] + best).sum() < 1
        assert all(licenses.grams(t) & set(model.triggers) for _, t, _ in licenses.notices())


def test_a_notice_may_be_wrapped_at_any_width(spark):
    said = {
        "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "mit": MIT,
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
    }
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    widths = (1, 2, 3, 4, 5, 9, 100)
    texts = {(f, n): wrap(t, n) for f, t in said.items() for n in widths}
    around = {(f, n): "\n".join([wrap(PROSE, n), wrap(t, n), wrap(PROSE, n)]) for f, t in said.items() for n in (2, 3)}
    keys = [*texts.items(), *around.items()]
    out = found(spark, {i: t for i, (_, t) in enumerate(keys)})
    for i, ((family, n), t) in enumerate(keys):
        assert out[i].licence == family, (family, n, t, out[i])
        assert out[i].confirmed or i >= len(texts), (family, n)
    assert found(spark, {1: wrap(" ".join([PROSE] * 5), 2)})[1].licence == "none"


def every_window(text):
    """The windows of each paragraph, whether they hold a trigger or not."""
    for paragraph in re.split(r"\n[\x20\x09-\x0D]*\n", text or ""):
        if not re.search(r"[^\x20\x09-\x0D]", paragraph):
            continue
        lines = [x for x in paragraph.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        found = {" ".join(lines[i : i + k]) for k in range(1, 5) for i in range(len(lines) - k + 1)}
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", " ".join(lines)) if w]
        if len(lines) > 4 and len(words) < 12 * len(lines):
            found |= {" ".join(words[i : i + 12 * k]) for i in range(0, len(words), 12) for k in range(1, 5)}
        yield found


def judged(line, model, known):
    """(minus score, family, unconfirmed), or None where no licence is likelier."""
    has = licenses.grams(line)
    at = [model.place[g] for g in has if g in model.place]
    if not at:
        return None
    z = np.round(model.weights[at].astype(float), 5).sum(0) + model.weights[-1]
    p = np.exp(z) / np.exp(z).sum()
    if p[-1] >= 0.5:
        return None
    score, family = min((-x, c) for x, c in zip(p[:-1], model.classes, strict=False))
    if -score < model.sure:
        return p[-1] - 1, licenses.UNKNOWN, True
    return score, family, not any(len(has & g) >= licenses.ENOUGH * len(g) for f, g in known if f == family)


def test_query_against_every_window(spark):
    """Every window of every whole text, scored one by one with the weights that the query learns."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = licenses.Model(licenses.other_lines(docs, "text"))
    known, kept = [(f, licenses.grams(t)) for f, t, _ in licenses.notices()], {}
    out = {r.doc_id: r for r in op4_license_scan(spark, str(DATA)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(out)
    for r in rows:
        paragraphs = list(every_window(r.text))
        best = []
        for windows in paragraphs:
            for w in windows - kept.keys():
                kept[w] = judged(w, model, known)
            best += [min(x)] if (x := [kept[w] for w in windows if kept[w]]) else []
        got = out[r.doc_id]
        assert (got.n_paragraphs, got.n_licence) == (len(paragraphs), len(best))
        assert got.licences == ",".join(sorted({f for _, f, _ in best}))
        score, family, unconfirmed = min(best, default=(0.0, licenses.NONE, True))
        assert (got.licence, got.confirmed) == (family, not unconfirmed)
        assert got.score == pytest.approx(-score, abs=1e-6)
    assert any(r.confirmed for r in out.values())
