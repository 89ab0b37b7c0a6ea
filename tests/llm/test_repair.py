import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest

from compare import DATA
from corpusloom.llm import queries, repair


def brute_codes(codes):
    """Least (cost, audit) over all edit sequences, layer by layer, without the graph."""
    states = {"": (0, "")}  # roles so far, shortened to what decides about the rest
    short = lambda roles: roles if len(roles) < 2 else roles[-1] if roles[-1] in "ua" else "x"
    ok = lambda roles: re.fullmatch("(s?(ua)*u?)?", roles)

    def inserted(found):
        out = dict(found)
        for _ in range(3):
            for roles, (cost, audit) in list(out.items()):
                for new in "ua":
                    put(out, roles, new, cost + 5, audit + "I")
        return out

    def put(out, roles, new, cost, audit):
        full = {"u": "u", "a": "ua", "": "", "s": "s"}[roles] + new
        if ok(full):
            key = "s" if full == "s" else short(full) if full else ""
            out[key] = min(out.get(key, (1 << 30, "")), (cost, audit))

    for code in codes:
        initial, fault = "?sua"[code // 3], code % 3
        after = {}
        for roles, (cost, audit) in inserted(states).items():
            put(after, roles, "", cost + 2, audit + "D")
            if fault != 1:
                more = 5 if fault == 2 else 0
                if initial != "?":
                    put(after, roles, initial, cost + more, audit + "K")
                for new in "ua":
                    put(after, roles, new, cost + 1 + more, audit + "R")
        states = after
    return min(v for k, v in inserted(states).items() if k in ("", "a"))


def test_all_short_conversations():
    for n in range(4):
        for codes in product(range(12), repeat=n):
            assert repair.cheapest(bytes(codes)) == brute_codes(codes), codes


def test_long_conversations_in_blocks():
    rng = random.Random(5)
    for n in (5, 40, 300):
        for _ in range(20):
            codes = bytes(rng.choices(range(12), weights=[1, 1, 1, 2, 1, 1, 9, 2, 2, 9, 2, 2], k=n))
            want = brute_codes(codes)
            assert all(repair.cheapest(codes, block) == want for block in (1, 7, 64, 1000))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(rows):
    out = Counter()
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, codes, n = set(), [], Counter()
        for _, _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            codes.append(3 * max(0, "?sua".find(role[:1] or "?")) + (2 if fault == "truncated" else 1 if fault else 0))
        cost, audit = brute_codes(codes)
        kept, at = [], iter(mine)
        for letter in audit:
            if letter == "I":
                kept.append(("user" if not kept or kept[-1][0][:1] in "sa" else "assistant", ""))
                continue
            _, _, role, text = next(at)
            if letter == "R":
                role = "user" if not kept or kept[-1][0][:1] in "sa" else "assistant"
            if letter != "D":
                kept.append((role, text))
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        said = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, said] += 1
    return out


SCHEMA = "conv_id long, turn long, role string, text string, there string, fault string, edit string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(None, i, "user", "x.") for i in range(4)] + [(1, None, None, None), (1, None, "user", "é…"), (2, 5, "assistant", "\n\t \x0b"), (2, 9, "", "end.\n ")]
    out += [(3, 1, "user", "same!")] * 5 + [(4, i, "system", "s.") for i in range(3)]
    for conv in range(10, 200):
        for turn in range(rng.randint(0, 9)):
            out.append((conv, turn + rng.randint(0, 2), rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(["a", "b.", " \n", "c?\t", "d… ", "e! f", "."]) * rng.randint(1, 3)))
    out += [(500, i, "assistant" if i % 2 else "user", f"{i % 7} very long. " * 40) for i in range(900)]
    out += [(conv, turn, role, "same!") for conv in range(1000, 1040) for turn, role in ((1, "user"), (2, "assistant")) for _ in range(6)]  # the first of equal rows isn't the duplicate
    out += [(conv, turn, "user", "gone.") for conv in range(600, 900) for turn in range(1) if zlib.crc32(f"{conv}:{turn}".encode()) % 20 == 0]
    return out


def test_conversations(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)
    want = brute(rows)
    broken = repair.damaged(df)
    for spool, block in ((repair.SPOOL, repair.BLOCK), (2000, 16)):  # in memory; through files and blocks
        edits = repair.repaired(broken, there="there", spool=spool, block=block)
        assert Counter(map(tuple, repair.report(edits).collect())) == want
    assert repair.report(repair.repaired(df.limit(0))).count() == 0


def test_edits(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "Hello."), (1, 2, "user", "Go on"), (1, 3, "user", "Go on")], "conv_id long, turn long, role string, text string")
    found = [(r.edit, r.was, r.role, r.text, r.fault, r.cost) for r in repair.repaired(df).orderBy("step").collect()]
    assert found == [("D", "assistant", None, "Hello.", None, 2), ("D", "user", None, "Go on", "truncated", 2), ("D", "user", None, "Go on", "duplicate", 2)]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, queries.op13_conversation_repair(spark, str(DATA)).collect())) == brute(rows)
