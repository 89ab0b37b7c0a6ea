"""Conversation structure repair: the cheapest edits that make turns alternate.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Its rows are
the layers of a graph with four states (nothing yet, after a system turn, after a
user's, after an assistant's); arcs keep a row, give it another role, delete it, or
insert an empty turn, and cost small integers.  Dial's bucket queue settles the
distances of all nodes to the end; then the tight arcs are walked from the start,
the ASCII-least letter first, which gives the least of all cheapest audits.

Rows are dealt by conversation and sorted there by turn (null first), role and text.
A task reads them as a stream: it keeps a byte per row, distances of ``BLOCK`` rows
(a longer conversation keeps the distances at its blocks' bounds and settles each
block again for the walk), and texts in memory up to ``SPOOL`` characters and beyond
that in an unnamed file of the task.  So a hot conversation takes one task's time,
since its audit and digest are chains over all its rows, but not its memory.

Null roles and texts are one space; a null conversation id is a conversation of its
own; of equal rows the first is a turn and the others are duplicates; a conversation
all of whose rows are dropped is still reported; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SPOOL = 1 << 14, 1 << 22
ROWS, CHARS = 2048, 1 << 23
#: Characters that count as white space, as a character class.
WHITE = r"\x20\x09-\x0D"

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What a turn given or inserted there leads to, and its role.
GIVEN = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (EMPTY, ASSISTANT)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
FAR = 1 << 60
#: Buckets in the ring: more than the dearest arc and than any two states of one row are apart.
RING = 32

INITIALS, SOUND, MUST_GO, TRUNCATED = "?sua", 0, 1, 2
EDITED = "conv_id long, step long, edit string, cost long, turn long, was string, role string, text string, fault string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits of a row, letters ascending."""
    initial, fault = INITIALS[code // 3], code % 3
    out = [("D", s, s, DELETE) for s in range(4)]
    if fault != MUST_GO:
        more = CUT_OFF if fault == TRUNCATED else 0
        out += [("K", s, to, more) for (s, first), to in KEPT.items() if first == initial]
        out += [("R", s, to, REROLE + more) for s, to in GIVEN.items()]
    return out


ARCS = [_arcs(code) for code in range(12)]
FORTH = [[[(letter, to, cost) for letter, s, to, cost in arcs if s == state] for state in range(4)] for arcs in ARCS]
BACK = [[[(s, cost) for _, s, to, cost in arcs if to == state] for state in range(4)] for arcs in ARCS]
INSERTED_FROM = [[s for s, to in GIVEN.items() if to == state] for state in range(4)]


def settle(codes: bytes, last: list[int]) -> list[int]:
    """Distance to the end of node (row, state) at 4 * row + state; ``last`` are those after the last row."""
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    done = bytearray(4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    now = min(last)
    left = 0
    for state, d in enumerate(last):
        if d < FAR:
            dist[4 * n + state] = d
            ring[d % RING].append(4 * n + state)
            left += 1
    while left:
        bucket = ring[now % RING]
        while bucket:
            node = bucket.pop()
            left -= 1
            if done[node] or dist[node] != now:
                continue
            done[node] = 1
            row, state = divmod(node, 4)
            for s in INSERTED_FROM[state]:
                before = 4 * row + s
                if now + INSERT < dist[before]:
                    dist[before] = now + INSERT
                    ring[(now + INSERT) % RING].append(before)
                    left += 1
            if row:
                for s, cost in BACK[codes[row - 1]][state]:
                    before = 4 * row - 4 + s
                    if now + cost < dist[before]:
                        dist[before] = now + cost
                        ring[(now + cost) % RING].append(before)
                        left += 1
        now += 1
    return dist


def _walk(codes: bytes, dist: list[int], state: int, whole: bool) -> tuple[str, int]:
    """(letters, state reached) along tight arcs, to the first node after the last row, and on to the end if ``whole``."""
    out, row = [], 0
    while True:
        d = dist[4 * row + state]
        if row == len(codes) and (not whole or d == 0):
            return "".join(out), state
        steps = [(letter, row + 1, to, cost) for letter, to, cost in FORTH[codes[row]][state]] if row < len(codes) else []
        steps.append(("I", row, GIVEN[state], INSERT))
        letter, row, state = min((letter, r, to) for letter, r, to, cost in steps if dist[4 * r + to] + cost == d)
        out.append(letter)


def cheapest(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of rows' codes."""
    starts = list(range(0, len(codes), block)) or [0]
    ends: list[list[int]] = [[]] * len(starts)
    last = [0 if s in ACCEPTED else FAR for s in range(4)]
    dist: list[int] = []
    for i in reversed(range(len(starts))):
        ends[i] = last
        dist = settle(codes[starts[i] : starts[i] + block], last)
        last = dist[:4]
    cost, state, audit = last[EMPTY], EMPTY, []
    for i, start in enumerate(starts):
        part = codes[start : start + block]
        if i:
            dist = settle(part, ends[i])
        letters, state = _walk(part, dist, state, i == len(starts) - 1)
        audit.append(letters)
    return cost, "".join(audit)


_short = lru_cache(1 << 16)(cheapest)


class _Spool:
    """Rows to be read once more: in memory up to ``most`` characters, then in an unnamed file."""

    def __init__(self, most: int):
        self.held: list[tuple] = []
        self.chars, self.most, self.file = 0, most, None

    def add(self, row: tuple) -> None:
        self.held.append(row)
        self.chars += len(row[1]) + len(row[2]) + 64
        if self.chars > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held, self.chars = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
            self.file.close()
        yield from self.held


def _code(role: str, fault: str | None) -> int:
    return 3 * max(0, INITIALS.find(role[:1] or "?")) + (SOUND if fault is None else TRUNCATED if fault == "truncated" else MUST_GO)


def _edits(conv: int | None, rows, spool: int, block: int) -> Iterator[tuple]:
    codes, held = bytearray(), _Spool(spool)
    for turn, role, text, fault in rows:
        codes.append(_code(role, fault))
        held.add((turn, role, text, fault))
    if not codes:
        yield conv, -1, None, 0, None, None, None, None, None
        return
    _, audit = cheapest(bytes(codes), block) if len(codes) > 64 else _short(bytes(codes))
    state, at = EMPTY, iter(held)
    for step, letter in enumerate(audit):
        if letter == "I":
            state = GIVEN[state]
            yield conv, step, letter, INSERT, None, None, NAMES[state], "", None
            continue
        turn, was, text, fault = next(at)
        if letter == "D":
            yield conv, step, letter, DELETE, turn, was, None, text, fault
            continue
        state = KEPT[state, was[0]] if letter == "K" else GIVEN[state]
        cost = (REROLE if letter == "R" else 0) + (CUT_OFF if fault == "truncated" else 0)
        yield conv, step, letter, cost, turn, was, was if letter == "K" else NAMES[state], text, fault


def _streamed(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, ROWS).columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if len(held) >= ROWS or chars >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.split() for x in schema.split(", ")]
    return [n for n, _ in pairs], [pa.int64() if k == "long" else pa.string() for _, k in pairs]


def _repaired(batches, spool: int, block: int):
    def rows():
        for conv, same in groupby(_streamed(batches), key=lambda r: r[0]):
            yield from _edits(conv, (r[2:] for r in same if r[1]), spool, block)

    yield from _batches(rows(), *_fields(EDITED), size=lambda row: len(row[7] or ""))


def damaged(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults drawn by CRC-32 of ``conv_id:turn``; ``there`` is false for a dropped row."""
    key = F.concat(F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    drawn = F.crc32(key) % 20
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(drawn == 4, "user").otherwise(F.coalesce(F.col(role).cast("string"), F.lit(" "))).alias("role"),
        F.when(drawn == 1, "").when(drawn == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.explode(F.array_repeat(drawn != 0, F.when(drawn == 3, 2).otherwise(1))).alias("there"),
    )


def _blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WHITE}]")


def _cut_off(text: Column) -> Column:
    return ~text.rlike(rf"[.!?][{WHITE}]*\z")


def repaired(
    rows: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    there: str | None = None,
    spool: int = SPOOL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per edit, a conversation's in order: conv_id, step, edit (K, R, D, I), cost, turn, was (role before),
    role (null if deleted), text, fault (blank, duplicate, truncated or null).

    ``there`` names a column that is false for rows to be passed over; a conversation without other rows has one row,
    step -1, without an edit.
    """
    source = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        (F.col(there) if there else F.lit(True)).alias("there"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    same = Window.partitionBy("conv_id", "there", F.xxhash64("role", "text"), "role", "text").orderBy("turn")
    seen = F.row_number().over(same) > 1
    fault = F.when(_blank(F.col("text")), "blank").when(seen, "duplicate").when(_cut_off(F.col("text")), "truncated")
    repeated = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # of equal rows the first is the one that isn't
    judged = source.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text", repeated)
    ordered = judged.select("conv_id", "there", "turn", "role", "text", "fault")
    return ordered.mapInArrow(lambda batches: _repaired(batches, spool, block), EDITED)


def _reported(batches):
    def rows():
        for conv, same in groupby(_streamed(batches), key=lambda r: r[0]):
            yield _report(conv, same)

    yield from _batches(rows(), *_fields(REPORT), size=lambda row: len(row[7]))


def _report(conv: int | None, rows) -> tuple:
    said, audit, cost, illegal, first = hashlib.sha256(), [], 0, 0, True
    found = {"blank": 0, "duplicate": 0, "truncated": 0}
    least = most = before = None
    turns = 0
    for _, step, edit, price, turn, was, role, text, fault in rows:
        if step < 0:
            continue
        audit.append(edit)
        cost += price
        if fault:
            found[fault] += 1
        if role is not None:
            said.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if edit == "I":
            continue
        illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
        before = was[:1]
        if turn is not None and turn != most:
            least = turn if least is None else least
            most, turns = turn, turns + 1
    gaps = most - least + 1 - turns if turns else 0
    return conv, gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, "".join(audit), said.hexdigest()


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation, read back from the edits, which lie as ``repaired`` returns them."""
    return edits.mapInArrow(_reported, REPORT)
