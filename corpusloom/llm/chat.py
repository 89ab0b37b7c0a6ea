"""Chat formatting: conversations rendered by a compiled template, and read back.

Rows of a conversation are dealt to one partition, sorted there by turn (then
role and text, so ties are settled) and rendered as a stream of blocks: a block is
closed after the turn with which it has ``block`` characters.  Most conversations are
one block; a very long one is many, and no task holds more than a few blocks of it.
Its digests go over its blocks in order, so one task reads them, with a block in
memory.  Blocks together say what the whole conversation would: ``loop`` counts on from
block to block, and what a template has before and after its loop over the messages
stands once.  A template that looks at the messages in any other way is rendered from
the whole conversation, which then is one block.

A null text or role is empty; a null conversation id is a conversation of its
own; equal rows are turns of their own; extra columns are ignored; an empty
table gives no rows.  Texts are escaped, so control strings inside them can
neither end a turn nor open one, and reading back restores them exactly.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.templates import compile_template, stream_template, unescape_control

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

TEMPLATE = (
    "{%- for message in messages -%}"
    "{{ '<|im_start|>' ~ (message.role | one_line) ~ '\n' }}"
    "{%- if message.role == 'assistant' -%}"
    "{% generation %}{{ message.text | escape_control }}{% endgeneration %}"
    "{%- else -%}{{ message.text | escape_control }}{%- endif -%}"
    "{{ '<|im_end|>' ~ '\n' }}"
    "{%- endfor -%}"
)

FORMATTED = "conv_id long, block long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Characters that close a block; blocks and characters that close an Arrow batch.
BLOCK, FLUSH, FLUSH_CHARS = 1 << 20, 64, 1 << 24


def _rows(batches):
    for batch in batches:
        ids, roles, texts = (batch.column(i) for i in range(3))
        for a in range(0, batch.num_rows, 512):
            yield from zip(*(c.slice(a, 512).to_pylist() for c in (ids, roles, texts)), strict=True)


def _blocks(rows, block: int | None):
    """(conversation, number of the block, the place of its first message, its messages, whether it is the last)."""
    for conv, same in groupby(rows, key=lambda r: r[0]):
        messages, chars, number, start = [], 0, 0, 0
        for _, role, text in same:
            if block is not None and chars >= block:
                yield conv, number, start, messages, False
                messages, chars, number, start = [], 0, number + 1, start + len(messages)
            messages.append({"role": role or "", "text": text or ""})
            chars += len(role or "") + len(text or "")
        yield conv, number, start, messages, True


def _formatted(batches, template: str, block: int):
    streamed, whole, out, chars = stream_template(template), compile_template(template), [], 0

    def batch():
        ids, blocks, n, texts, spans = zip(*out, strict=True)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        longs = [pa.array(x, pa.int64()) for x in (ids, blocks, n)]
        loss = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
        return pa.RecordBatch.from_arrays([*longs, pa.array(texts, pa.string()), loss], ["conv_id", "block", "n_turns", "formatted", "loss"])

    for conv, number, start, messages, last in _blocks(_rows(batches), block if streamed else None):
        rendered = streamed.render(messages, start, last) if streamed else whole({"messages": messages})
        out.append((conv, number, len(messages), *rendered))
        chars += len(out[-1][3])
        if len(out) >= FLUSH or chars >= FLUSH_CHARS:
            yield batch()
            out.clear()
            chars = 0
    if out:
        yield batch()


def format_conversations(
    conversations: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: str = TEMPLATE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per block of a conversation, numbered from 0: conv_id, block, n_turns, formatted text, loss (code point spans)."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(turn).alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.drop("turn").mapInArrow(lambda batches: _formatted(batches, template, block), FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a formatted block holds."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, text = part.removesuffix("\n").removesuffix(CLOSE).partition("\n")
        out.append((_role(role), unescape_control(text)))
    return out


def _role(role: str) -> str:
    if "\\" not in role:
        return role
    out, at = [], 0
    while at < len(role):
        if role[at] == "\\":
            at += 1
            out.append("\n" if role[at] == "n" else role[at])
        else:
            out.append(role[at])
        at += 1
    return "".join(out)


class _Digests:
    """What is read back of one conversation, block by block."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.masked, self.chars = conv, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list) -> None:
        for role, said in read_turns(text):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        for span in spans:
            masked = unescape_control(text[span["start"] : span["end"]])
            self.masked += len(masked)
            self.loss.update(masked.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.conv, self.turns, self.said.hexdigest(), self.masked, self.loss.hexdigest(), self.chars


def _read(batches):
    def batch():
        ids, n, said, masked, loss, chars = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(said), pa.array(masked, pa.int64()), pa.array(loss), pa.array(chars, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    out, open_ = [], None
    for whole in batches:
        for a in range(0, whole.num_rows, FLUSH):
            for conv, number, text, spans in zip(*(c.to_pylist() for c in whole.slice(a, FLUSH).columns), strict=True):
                if number == 0:
                    if open_:
                        out.append(open_.row())
                    open_ = _Digests(conv)
                open_.add(text, spans)
            if len(out) >= 1000:
                yield batch()
                out.clear()
    if open_:
        out.append(open_.row())
        yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation: digests of the turns and of the masked text, taken from the formatted text alone.

    A conversation's blocks are in one partition in their order, as ``format_conversations`` returns them.
    """
    return formatted.select("conv_id", "block", "formatted", "loss").mapInArrow(_read, READ)
