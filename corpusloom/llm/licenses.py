"""Licence notices: paragraphs classified by family, in DataFrame functions only.

A paragraph is a run of lines that aren't blank.  What is classified are its
*windows*, of one to ``LINES`` consecutive lines joined by spaces, so that a notice
wrapped over lines is read whole and one in a long paragraph isn't drowned.  Where a
paragraph has more lines than that, of fewer than ``UNIT`` words on average, windows of
one to ``LINES`` runs of ``UNIT`` words are read as well, so it doesn't matter how narrow a
notice is wrapped.  A
logistic regression over word 1- and 2-grams (present or not) tells licence
families from each other and from other text.  It is trained here, on notices made
from the families' names and usual sentences, and on at most ``OTHERS`` lines of
the corpus that name no licence (a bounded sample, by hash).

Calibration uses notices unlike those learned from: sentences left out in turn
give the temperature; families left out in turn show how likely the best of the
wrong families gets, which sets the limit below which a notice is ``unknown``.

1. One pass over the texts keeps the windows that hold a *trigger*.  Triggers are
   words chosen until this is proven: what has no n-gram with a trigger in it is
   likelier no licence than one, even if it held all other n-grams that speak for
   a family.  So no window that counts is left out.
2. Each distinct window is scored once: its n-grams meet the broadcast weights (one
   row per n-gram of the notices, so bounded by them).
3. A window is of the family of highest probability; ``unknown`` if it is likelier
   than not a licence but no family reaches the limit.  A paragraph takes its
   likeliest window.
4. A family is *confirmed* if the window holds ``ENOUGH`` of the n-grams of one of
   the family's notices.

Null and empty texts have no paragraphs and no licence; equal rows get equal
results; of several families the likeliest paragraph's is the text's, ties by name;
ids may be null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch

OTHERS, SAMPLE, ENOUGH, LINES, UNIT = 3000, 64, 0.7, 4, 12
#: Parts that sentences and families are left out in, and how many other lines and rounds those fits take.
PARTS, FEW_OTHERS, FEW_ROUNDS = 3, 400, 80
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
NONE, UNKNOWN = "none", "unknown"

#: Names of the families, and sentences that notices are made of.
FAMILIES = {
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD License"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GNU GPL v3", "GPL v2", "GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU LGPL v2.1", "LGPL-3.0", "GNU Lesser General Public License"],
    "mit": ["MIT License", "MIT Licence", "terms of the MIT License", "Expat License"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0 1.0", "Unlicense"],
}
SENTENCES = ["This work is licensed under the {}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}; see the file for details.", "This software is available under {}.", "This file is subject to the terms of the {}.", "License: {}", "Published under {}."]
OWN = {
    "apache": ["you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "The above copyright notice and this permission notice shall be included in all copies."],
    "public-domain": ["This work is in the public domain.", "Dedicated to the public domain.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 by the author. All rights reserved.", "Copyright 2019. All rights reserved worldwide.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Unauthorised copying of this file is strictly prohibited. Proprietary and confidential.", "All rights are reserved by the owner."],
}
#: What is plainly no licence though it shares words with them.
PLAIN = ["He lost his driving license on the way to the public library.", "The general version of the work was released under a new name.", "All of the files are reserved for the next meeting.", "Permission to land was granted by the tower.", "The domain of the function is all real numbers.", "Terms and conditions of the lease are in the annex.", "Nobody can be without a new plan for all of it, the person said.", "He made use of every written source.", "The patent was published under his name in version 2.0 of the report.", "The and of to in a is that it was for on with as by at from this be are or an not all any.", "It is for the use of all, and this or that is in it.", "He was at the house of the owner, and the other was not.", "Der die das und in zu den von mit ist", "le la les de des et en un une est que", "el la los las de y en un una que por"]
#: Words that say nothing of a licence; n-grams of such words only aren't looked at, nor of words in more than this share of other lines.
USUAL = "a above all an and any are as at be been but by can do for from had has have he her his if in into is it its may me my new no not of on one or other our out said see shall she so such that the their them then there these they this those to up was we were what when which who will with without would you your"
USUAL_SHARE = 0.01
NAMES_ONE = r"(?i)licen[cs]e|copyright|rights (?:are )?reserved|public domain|creative commons|\bgpl\b|redistribut"


def grams(text: str) -> set[str]:
    words = re.findall(WORD, text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def notices() -> list[tuple[str, str, int]]:
    """(family, text, sentence) of everything that is learned from; a sentence has the same number in all families."""
    out = [(family, s.format(name), i) for family, names in FAMILIES.items() for name in names for i, s in enumerate(SENTENCES)]
    for family, texts in OWN.items():
        for i, s in enumerate(texts):
            words = s.split()
            n = len(words) if len(words) > 12 else 0  # long ones also in part
            out += [(family, " ".join(t), i) for t in (words, words[: n // 2], words[n // 2 :], words[: 2 * n // 3]) if t and (n or t is words)]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Model:
    """Weights by n-gram and class, the last class being no licence; the triggers; the temperature and the limit."""

    def __init__(self, others: list[str], rounds: int = 300):
        known = notices()
        self.classes = [*sorted({f for f, _, _ in known}), NONE]
        others = others + [""] * len(PLAIN)
        texts = [t for _, t, _ in known] + PLAIN + others
        none = len(self.classes) - 1
        labels = np.array([self.classes.index(f) for f, _, _ in known] + [none] * (len(PLAIN) + len(others)))
        sets = [grams(t) for t in texts]
        seen = Counter(w for s in sets[len(known) + len(PLAIN) :] for w in s if " " not in w)
        usual = {*USUAL.split(), *(w for w, n in seen.items() if n > USUAL_SHARE * len(others))}
        self.grams = sorted(g for g in set().union(*sets[: len(known)]) if not usual.issuperset(g.split(" ")))
        self.place = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        x[:, -1] = 1
        for i, s in enumerate(sets):
            x[i, [self.place[g] for g in s if g in self.place]] = 1
        few = np.arange(len(texts)) < len(known) + len(PLAIN) + FEW_OTHERS
        sentence = np.array([i for _, _, i in known] + [i % PARTS for i in range(len(texts) - len(known))])
        self.sharpness, self.sure = self._calibrated(x[few], labels[few], sentence[few])
        self.weights = self._fit(x, labels, rounds) * self.sharpness
        self.triggers = self._triggers({w: n / len(others) for w, n in seen.items()}, usual)

    def _fit(self, x: np.ndarray, labels: np.ndarray, rounds: int) -> np.ndarray:
        """Multinomial logistic regression by accelerated gradient steps; the families together weigh as much as other text."""
        target = np.eye(len(self.classes), dtype=np.float32)[labels]
        counts = np.maximum(target.sum(0), 1)
        share = np.full(len(self.classes), 0.5 / (len(self.classes) - 1))
        share[-1] = 0.5
        weight = (share / counts)[labels][:, None] * len(labels)
        w = np.zeros((x.shape[1], len(self.classes)), np.float32)
        ahead = w
        for k in range(rounds):
            step = ahead - 0.5 * (x.T @ (weight * (_softmax(x @ ahead) - target)) / len(labels) + 1e-4 * ahead)
            ahead = step + k / (k + 3) * (step - w)
            w = step
        return w

    def _calibrated(self, x: np.ndarray, labels: np.ndarray, sentence: np.ndarray) -> tuple[float, float]:
        """(the factor of the logits under which sentences left out are likeliest, the limit that best tells them from families left out)."""
        none = len(self.classes) - 1
        z = np.zeros((len(x), none + 1), np.float32)
        for part in range(PARTS):
            out = sentence % PARTS == part
            z[out] = x[out] @ self._fit(x[~out], labels[~out], FEW_ROUNDS)
        cost = lambda s: -float(np.log(_softmax(s * z)[np.arange(len(z)), labels] + 1e-12).mean())
        sharpness = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=cost)
        p = _softmax(sharpness * z)
        is_notice = labels < none
        right = p[is_notice].argmax(1) == labels[is_notice]
        known = p[is_notice][:, :none].max(1)[right]
        strange = []
        for part in range(PARTS):
            out = is_notice & (labels % PARTS == part)
            q = _softmax(sharpness * (x[out] @ self._fit(x[~out], labels[~out], FEW_ROUNDS)))
            strange.append(q[q[:, none] < 0.5][:, :none].max(1))
        strange = np.concatenate(strange)
        told = lambda t: float((known >= t).mean()) + float((strange < t).mean() if len(strange) else 0)
        return sharpness, max((round(0.3 + 0.05 * i, 2) for i in range(13)), key=lambda t: (told(t), -t))

    def _triggers(self, usual: dict[str, float], never: set[str]) -> list[str]:
        """Words such that all n-grams without any of them can't make a licence likelier than not.

        ``usual``: the share of other lines that hold a word, which is then rather not taken; ``never``: words that no n-gram is made of alone.
        """
        for_family = np.maximum(self.weights[:-1, :-1] - self.weights[:-1, -1:], 0).astype(np.float64)  # by n-gram and family
        bias = (self.weights[-1, :-1] - self.weights[-1, -1]).astype(np.float64)
        of_word: dict[str, list[int]] = {}
        for i, g in enumerate(self.grams):
            for w in g.split(" "):
                of_word.setdefault(w, []).append(i)
        left = np.ones(len(self.grams), bool)
        out: list[str] = []
        # Not 1, since weights are rounded where they are used.
        while np.exp(bias + for_family[left].sum(0)).sum() > 0.99:
            worst = np.exp(bias + for_family[left].sum(0))

            def gain(w: str, worst: np.ndarray = worst) -> tuple[float, str]:
                mine = [i for i in of_word[w] if left[i]]
                less = float((worst / worst.sum() * for_family[mine].sum(0)).sum()) if mine else 0.0
                return less / (usual.get(w, 0.0) + 1e-3), w

            best = max((w for w in of_word if w not in out and w not in never), key=gain)
            if gain(best)[0] <= 0:
                break
            out.append(best)
            left[of_word[best]] = False
        return out


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from what the driver holds, made in the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _grams(line) -> F.Column:
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: F.contains(p, F.lit(" ")))))


def other_lines(docs: DataFrame, text: str) -> list[str]:
    """At most OTHERS lines of a sample of the texts, the first by hash, that name no licence."""
    some = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0)
    lines = some.select(F.explode(F.split("t", "\n")).alias("line")).where(F.col("line").rlike(r"\S") & ~F.col("line").rlike(NAMES_ONE))
    return [r.line for r in lines.distinct().orderBy(F.xxhash64("line"), "line").limit(OTHERS).collect()]


def verdicts(spark: SparkSession, lines: DataFrame, model: Model) -> DataFrame:
    """(h, family, score, confirmed) of distinct windows (h, line)."""
    k = len(model.classes)
    rows = [{"g": g, "w": [round(float(v), 5) for v in w]} for g, w in zip(model.grams, model.weights[:-1], strict=True)]
    weights = _table(spark, rows, "g string, w array<double>")
    each = lines.select("h", _grams(F.col("line")).alias("gs")).select("h", F.explode("gs").alias("g"))
    bias = model.weights[-1]
    sums = each.join(F.broadcast(weights), "g").groupBy("h").agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)))
    raised = sums.select("h", F.array(*(F.exp(F.col(f"z{i}") + float(bias[i])) for i in range(k))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    shares = raised.select("h", F.transform("e", lambda x: x / total).alias("p"))
    named = F.array(*(F.struct(F.col("p")[i].alias("p"), F.lit(c).alias("family")) for i, c in enumerate(model.classes[:-1])))
    ranked = F.array_sort(F.transform(named, lambda s: F.struct((-s["p"]).alias("down"), s["family"].alias("family"))))
    best = shares.select("h", F.col("p")[k - 1].alias("other"), ranked[0].alias("best")).where(F.col("other") < 0.5)
    family = F.when(-F.col("best.down") >= model.sure, F.col("best.family")).otherwise(UNKNOWN)
    found = best.select("h", family.alias("family"), F.when(family == UNKNOWN, 1 - F.col("other")).otherwise(-F.col("best.down")).alias("score"))
    # The notices of a family, n-gram by n-gram.
    known = [{"family": f, "id": i, "size": len(s), "g": g} for i, (f, t, _) in enumerate(notices()) for s in [grams(t)] for g in s]
    shared = found.join(each, "h").join(F.broadcast(_table(spark, known, "family string, id int, size int, g string")), ["family", "g"])
    held = shared.groupBy("h", "id").agg((F.count("*") / F.max("size")).alias("share")).groupBy("h").agg(F.max("share").alias("share"))
    return found.join(held, "h", "left").select("h", "family", "score", (F.coalesce("share", F.lit(0.0)) >= ENOUGH).alias("confirmed"))


def windows(lines, words, trigger: str):
    """The windows of an array of lines that hold a trigger, once each; words: those of lines to be read in units too, else none.

    Both are columns, not expressions: they are looked at once for each window.
    """

    def runs(parts):
        n = F.size(parts)
        return F.flatten(F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(LINES)), lambda k: F.when(k <= n, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " "))))))

    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(UNIT))).otherwise(F.array().cast("array<int>"))
    units = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LINES), F.ceil((n - i + 1) / UNIT).cast("int"))), lambda k: F.array_join(F.slice(words, i, k * UNIT), " "))))
    return F.array_distinct(F.filter(F.concat(runs(lines), units), lambda x: x.rlike(trigger)))


def narrow_words(lines):
    """The words of lines that are more than a window has, and shorter than a unit on average; else none."""
    words = F.filter(F.split(F.array_join(lines, " "), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((F.size(lines) > LINES) & (F.size(words) < UNIT * F.size(lines)), words).otherwise(F.array().cast("array<string>"))


def scanned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs, n_licence, licences (names joined), licence, score, confirmed."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licences")
    model = Model(other_lines(docs, text))
    trigger = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in model.triggers) + r")(?![a-z0-9])"
    t = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.split(t, r"\n[\x20\x09-\x0D]*\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Only texts that hold a trigger are split twice.
    asked = F.when(t.rlike(trigger), F.filter(paragraphs, lambda x: x.rlike(trigger))).otherwise(F.array().cast("array<string>"))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("fp"), F.size(paragraphs).cast("long").alias("n_paragraphs"), asked.alias("asked"))
    read = scratch.table(read, "read")
    each = read.where(F.size("asked") > 0).select("doc_id", "fp", F.posexplode("asked").alias("pos", "paragraph")).distinct()
    lines = F.filter(F.split("paragraph", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    each = each.select("doc_id", "fp", "pos", lines.alias("lines")).select("doc_id", "fp", "pos", "lines", narrow_words(F.col("lines")).alias("words"))
    each = each.select("doc_id", "fp", "pos", F.explode(windows(F.col("lines"), F.col("words"), trigger)).alias("line")).withColumn("h", F.xxhash64("line"))
    each = scratch.table(each, "windows")
    distinct = scratch.table(each.groupBy("h").agg(F.min("line").alias("line")), "distinct")
    judged = scratch.table(verdicts(spark, distinct, model), "verdicts")
    place = F.min(F.struct((-F.col("score")).alias("down"), "family", (~F.col("confirmed")).alias("open"))).alias("place")
    hits = each.drop("line").join(judged, "h").groupBy("doc_id", "fp", "pos").agg(place)
    by_text = hits.groupBy("doc_id", "fp").agg(F.count("*").alias("n_licence"), F.array_join(F.array_sort(F.collect_set("place.family")), ",").alias("licences"), F.min("place").alias("first"))
    found = by_text.select(F.col("doc_id").alias("f_id"), F.col("fp").alias("f_fp"), "n_licence", "licences", "first")
    joined = read.join(found, read["doc_id"].eqNullSafe(F.col("f_id")) & (read["fp"] == F.col("f_fp")), "left")
    return joined.select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("n_licence", F.lit(0).cast("long")).alias("n_licence"),
        F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("first.family", F.lit(NONE)).alias("licence"),
        F.coalesce(-F.col("first.down"), F.lit(0.0)).alias("score"),
        F.coalesce(~F.col("first.open"), F.lit(False)).alias("confirmed"),
    )
