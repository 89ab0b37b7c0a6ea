"""A small template language for conversations: parsed, folded and compiled to closures.

    text {{ expression }} {# comment #}
    {% for x in list %} ... {% endfor %}     with loop.index, index0, first, last
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %} marks what a model is trained on

``-`` inside a delimiter strips the white space beside it.  Expressions have
literals, names, ``a.b``, ``a['b']``, ``+ ~ == != in not and or``, parentheses and
filters (``x | trim``).  They reach only the values given to ``render``: no
calls, no Python attributes, no names with a leading underscore.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    pass


def escape_control(text: str) -> str:
    r"""Puts a backslash before each backslash and inside each ``<|``, so no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape_control(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "escape_control": lambda x: escape_control(str(x)),
    "one_line": lambda x: str(x).replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\|"),
}


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass
class Block:
    kind: str
    head: object = None
    body: list = field(default_factory=list)
    other: list = field(default_factory=list)


_LEX = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z]\w*)|(==|!=|[-+~|.\[\]()=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            number, single, double, name, sign = m.groups()
            if number is not None:
                self.tokens.append(("const", int(number)))
            elif name is not None:
                self.tokens.append(("name", name))
            elif sign is not None:
                self.tokens.append(("sign", sign))
            else:
                s = single if single is not None else double
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), s, flags=re.S)))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value}")

    def whole(self):
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = fold(Op("or", (out, self.both())))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = fold(Op("and", (out, self.negated())))
        return out

    def negated(self):
        return fold(Op("not", (self.negated(),))) if self.take("not") else self.compared()

    def compared(self):
        out = self.joined()
        while op := self.take("==", "!=", "in"):
            out = fold(Op(op, (out, self.joined())))
        return out

    def joined(self):
        out = self.filtered()
        while op := self.take("+", "~"):
            out = fold(Op(op, (out, self.filtered())))
        return out

    def filtered(self):
        out = self.reached()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = fold(Filter(name, out))
        return out

    def reached(self):
        out = self.single()
        while op := self.take(".", "["):
            if op == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("expected a name after .")
                self.at += 1
                out = Get(out, Const(name))
            else:
                out = Get(out, self.either())
                self.need("]")
            out = fold(out)
        return out

    def single(self):
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("unfinished expression")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return Const(words[value]) if value in words else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def fold(node):
    """The node, or its value where all it needs is constant."""
    parts = node.args if isinstance(node, Op) else (node.of, node.key) if isinstance(node, Get) else (node.of,)
    return Const(closure(node)({})) if all(isinstance(p, Const) for p in parts) else node


def _get(of, key):
    if isinstance(of, dict) and isinstance(key, str):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


_BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}"}


def closure(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda names, value=node.value: value
    if isinstance(node, Name):
        return lambda names, name=node.name: names.get(name)
    if isinstance(node, Get):
        of, key = closure(node.of), closure(node.key)
        return lambda names: _get(of(names), key(names))
    if isinstance(node, Filter):
        f, of = FILTERS[node.name], closure(node.of)
        return lambda names: f(of(names))
    first, *rest = map(closure, node.args)
    if node.op == "not":
        return lambda names: not first(names)
    if node.op == "and":
        return lambda names: first(names) and rest[0](names)
    if node.op == "or":
        return lambda names: first(names) or rest[0](names)
    return lambda names, f=_BINARY[node.op]: f(first(names), rest[0](names))


_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)


def parse(source: str) -> list:
    """The syntax tree: constants, expressions and blocks, neighbouring constants joined."""
    root: list = []
    stack: list[Block] = [Block("root", body=root)]
    here = [root]
    strip = False
    parts = _PARTS.split(source)
    for i, part in enumerate(parts):
        if i % 2 == 0:
            text = part.lstrip() if strip else part
            following = parts[i + 1] if i + 1 < len(parts) else ""
            text = text.rstrip() if following[2:3] == "-" and following[1] != "#" else text
            if text:
                _add(here[-1], Const(text))
            strip = False
            continue
        strip = part[-3] == "-" and part[1] != "#"
        inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
        if part[1] == "#":
            continue
        if part[1] == "{":
            _add(here[-1], _Expression(inner).whole())
            continue
        word, _, rest = inner.partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError(f"bad for: {rest}")
            block = Block("for", (m[1], _Expression(m[2]).whole()))
        elif word == "if":
            block = Block("if", _Expression(rest).whole())
        elif word == "generation":
            block = Block("generation")
        elif word == "set":
            name, _, value = rest.partition("=")
            here[-1].append(Block("set", (name.strip(), _Expression(value).whole())))
            continue
        elif word in ("elif", "else") and stack[-1].kind == "if":
            here[-1] = stack[-1].other
            if word == "elif":
                block = Block("if", _Expression(rest).whole())
                here[-1].append(block)
                block.kind, stack[-1] = "if", block
                here[-1] = block.body
            continue
        elif word.startswith("end") and len(stack) > 1 and stack[-1].kind == word[3:]:
            stack.pop()
            here.pop()
            continue
        else:
            raise TemplateError(f"unexpected {word}")
        here[-1].append(block)
        stack.append(block)
        here.append(block.body)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1].kind} is not closed")
    return root


def _add(body: list, node) -> None:
    if isinstance(node, Const):
        node = Const("" if node.value is None else str(node.value))
        if body and isinstance(body[-1], Const):
            body[-1] = Const(body[-1].value + node.value)
            return
    body.append(node)


class Output:
    """Pieces written so far, their length in code points and the generation spans."""

    def __init__(self):
        self.pieces, self.size, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _body(nodes: list) -> Callable[[dict, Output], None]:
    steps = [_step(n) for n in nodes]

    def run(names: dict, out: Output) -> None:
        for step in steps:
            step(names, out)

    return run


def _step(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Const):
        return lambda names, out, text=node.value: out.put(text)
    if not isinstance(node, Block):
        value = closure(node)

        def put(names, out):
            v = value(names)
            out.put("" if v is None else str(v))

        return put
    body, other = _body(node.body), _body(node.other)
    if node.kind == "if":
        if isinstance(node.head, Const):
            return body if node.head.value else other
        test = closure(node.head)
        return lambda names, out: body(names, out) if test(names) else other(names, out)
    if node.kind == "set":
        name, value = node.head[0], closure(node.head[1])
        return lambda names, out: names.__setitem__(name, value(names))
    if node.kind == "generation":

        def mark(names, out):
            start = out.size
            body(names, out)
            out.spans.append((start, out.size))

        return mark
    name, of = node.head[0], closure(node.head[1])

    def loop(names, out):
        rows = of(names) or []
        for i, x in enumerate(rows):
            body(names | {name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(rows) - 1}}, out)

    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names to (text, generation spans in code points)."""
    run = _body(parse(source))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(names), out)
        return "".join(out.pieces), out.spans

    return render


def _mentions(node, name: str) -> bool:
    if isinstance(node, (list, tuple)):
        return any(_mentions(n, name) for n in node)
    if isinstance(node, Name):
        return node.name == name
    if isinstance(node, Block):
        return any(_mentions(n, name) for n in (node.head, node.body, node.other))
    return any(_mentions(n, name) for n in vars(node).values()) if isinstance(node, (Get, Op, Filter)) else False


class Streamed:
    """A template that is one loop over a list, with something before and after it: the list may come in parts.

    What an element is rendered to depends on itself and its place only, so parts rendered one after the other say
    what the whole list would.
    """

    def __init__(self, before: list, loop: Block, after: list):
        self.before, self.after, self.name, self.body = _body(before), _body(after), loop.head[0], _body(loop.body)

    def render(self, part: list, start: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans) of a part that begins at place ``start`` of the list, and ends it if ``last``."""
        out, names = Output(), {}
        self.before(names, out if start == 0 else Output())  # its variables hold in every part
        for i, x in enumerate(part, start):
            place = {"index": i + 1, "index0": i, "first": i == 0, "last": last and i == start + len(part) - 1}
            self.body(names | {self.name: x, "loop": place}, out)
        if last:
            self.after(names, out)
        return "".join(out.pieces), out.spans


def stream_template(source: str, over: str = "messages") -> Streamed | None:
    """The template as one that takes the list ``over`` in parts; None if it looks at the list in any other way."""
    root = parse(source)
    loops = [i for i, n in enumerate(root) if isinstance(n, Block) and n.kind == "for" and n.head[1] == Name(over)]
    if len(loops) != 1:
        return None
    before, loop, after = root[: loops[0]], root[loops[0]], root[loops[0] + 1 :]
    return None if _mentions([before, loop.body, after], over) else Streamed(before, loop, after)
