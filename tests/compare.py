"""Rows of Spark and DuckDB in one comparable form."""

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (int, float)):
        return round(float(x), 4) if not math.isnan(x) else "nan"
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    want = rows(names, want.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, bad[:3]
