import random

import pytest

from corpusloom.llm.components import connected_components
from corpusloom.llm.scratch import Scratch


def brute(edges):
    lead = {n: n for e in edges for n in e}

    def root(n):
        while lead[n] != n:
            n = lead[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        lead[y] = x
    return {n: root(n) for n in lead}


rng = random.Random(7)
names = rng.sample(range(-(10**9), 10**9), 400)
GRAPHS = {
    "none": [],
    "path in order": [(i, i + 1) for i in range(60)],
    "path of names": list(zip(names[:200], names[1:201], strict=True)),
    "star around the greatest": [(1000, i) for i in range(50)],
    "repeated, reversed and to itself": [(3, 5), (5, 3), (3, 5), (7, 7), (9, 5)],
    "sparse": [tuple(rng.sample(names, 2)) for _ in range(220)],
}


@pytest.mark.parametrize("kind", GRAPHS)
def test_components(spark, kind):
    edges = spark.createDataFrame(GRAPHS[kind], "a long, b long").repartition(3)
    rows = connected_components(edges, Scratch(spark, "test"), "c").collect()
    assert {r.node: r.component for r in rows} == brute(GRAPHS[kind]) and len(rows) == len(brute(GRAPHS[kind]))
