"""A sandboxed template language for conversations, compiled to Python closures.

Statements: text, {{ value }}, {% if %} / {% elif %} / {% else %} / {% endif %}, {% for x in xs %} / {% endfor %},
{% set x = value %}, {% generation %} / {% endgeneration %}, {# comment #}; a dash inside a tag's brace trims white
space next to it. Values: strings, whole numbers, true, false, none, names, [lists], .key and [key], + - ~ and
comparisons, in, not, and, or, and filters (value | upper). Names read only what the caller passes in and what the
template sets; keys read only dict entries and list places, so no Python attribute or call can be reached.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template can't be parsed, or reads what it may not."""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    values: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    value: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter over values."""

    name: str
    args: tuple


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>.,|()\[\]=]))")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _show(value: Any) -> str:
    return "" if value is None else str(value)


FILTERS: dict[str, Callable] = {
    "upper": lambda x: _show(x).upper(),
    "lower": lambda x: _show(x).lower(),
    "trim": lambda x: _show(x).strip(),
    "length": len,
    "default": lambda x, other: other if x is None else x,
    "join": lambda xs, by="": by.join(map(_show, xs)),
}
_OPERATORS: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "~": lambda a, b: _show(a) + _show(b), "not": operator.not_, **_COMPARE}


class Escape:
    """A reversible escape under which a text can't hold any of the control strings.

    The backslash and the first character of every control string become a backslash and a letter.
    """

    def __init__(self, control: tuple[str, ...]):
        chars = ["\\", *sorted({c[0] for c in control} - {"\\"})]
        if len(chars) > 26:
            raise TemplateError("too many control strings")
        letters = [chr(ord("a") + i) for i in range(len(chars))]
        if {c for s in control for c in s[:1]} & set(letters):
            raise TemplateError("a control string starts with a letter of the escape")
        self.table = {ord(c): "\\" + x for c, x in zip(chars, letters, strict=True)}
        self.back = dict(zip(letters, chars, strict=True))

    def __call__(self, value: Any) -> str:
        return _show(value).translate(self.table)

    def undo(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: self.back[m[1]], text, flags=re.S) if "\\" in text else text


class _Values:
    """Recursive descent over the tokens of a tag."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        end = 0
        while source[end:].strip():
            m = _TOKEN.match(source, end)
            if not m:
                raise TemplateError(f"unexpected {source[end:].strip()[:20]!r}")
            self.tokens.append(("num", int(m[1])) if m[1] else ("str", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[2][1:-1], flags=re.S)) if m[2] is not None else ("name", m[3]) if m[3] else ("op", m[4]))
            end = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self, value: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def value(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.summed()
        if self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
            self.at += 2
            return Apply("not", (Apply("in", (left, self.summed())),))
        op = self.take(*_COMPARE)
        return Apply(op, (left, self.summed())) if op else left

    def summed(self) -> Any:
        left = self.piped()
        while op := self.take("+", "-", "~"):
            left = Apply(op, (left, self.piped()))
        return left

    def piped(self) -> Any:
        left = self.held()
        while self.take("|"):
            name, args = self.name(), [left]
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.value())
                    self.take(",")
            left = Apply("|" + name, tuple(args))
        return left

    def held(self) -> Any:
        left = self.single()
        while op := self.take(".", "["):
            if op == ".":
                left = Item(left, Const(self.name()))
            else:
                left = Item(left, self.value())
                self.need("]")
        return left

    def single(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind in ("num", "str"):
            return Const(token)
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[token]) if token in fixed else Name(token)
        if token == "(":
            inner = self.value()
            self.need(")")
            return inner
        if token == "[":
            items = []
            while not self.take("]"):
                items.append(self.value())
                self.take(",")
            return Apply("list", tuple(items))
        raise TemplateError(f"unexpected {token!r}")


def parse(source: str, filters: dict[str, Callable] = FILTERS) -> tuple:
    """The syntax tree: a tuple of statements."""
    parts, end, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[end : m.start()]
        text = text.lstrip() if trim else text
        parts.append(Text(text.rstrip() if source[m.start() + 2] == "-" else text))
        trim, end = source[m.end() - 3] == "-", m.end()
        if m[1] is not None:
            values = _Values(m[1], filters)
            parts.append(Print(values.end(values.value())))
        elif m[2] is not None:
            parts.append(_Values(m[2], filters))
    parts.append(Text(source[end:].lstrip() if trim else source[end:]))
    at = 0

    def block(*ends: str) -> tuple[tuple, str, Any]:
        nonlocal at
        body = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if not isinstance(part, _Values):
                body.append(part)
                continue
            word = part.name()
            if word in ends:
                return tuple(body), word, part
            if word == "if":
                branches, test = [], part.end(part.value())
                while True:
                    inner, word, tag = block("elif", "else", "endif")
                    branches.append((test, inner))
                    if word != "elif":
                        break
                    test = tag.end(tag.value())
                body.append(If(tuple(branches), block("endif")[0] if word == "else" else ()))
            elif word == "for":
                name = part.name()
                part.need("in")
                values = part.end(part.value())
                body.append(For(name, values, block("endfor")[0]))
            elif word == "set":
                name = part.name()
                part.need("=")
                body.append(Assign(name, part.end(part.value())))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(body), "", None

    return block()[0]


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, list | str) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"{key!r} can't be read here")


def _operator(name: str, filters: dict[str, Callable]) -> Callable:
    return (lambda *xs: list(xs)) if name == "list" else filters[name[1:]] if name[0] == "|" else _OPERATORS[name]


def fold(node: Any, filters: dict[str, Callable] = FILTERS) -> Any:
    """The tree with constant values worked out, dead branches cut and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for part in node:
            folded = fold(part, filters)
            for x in folded if isinstance(folded, tuple) else (folded,):
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + x.value)
                elif not (isinstance(x, Text) and not x.value):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        if node.name in ("and", "or"):
            left, right = args
            return Apply(node.name, args) if not isinstance(left, Const) else right if bool(left.value) == (node.name == "and") else left
        if all(isinstance(a, Const) for a in args) and node.name != "list":
            return Const(_operator(node.name, filters)(*(a.value for a in args)))
        return Apply(node.name, args)
    if isinstance(node, Item):
        return Item(fold(node.value, filters), fold(node.key, filters))
    if isinstance(node, Print):
        value = fold(node.value, filters)
        return Text(_show(value.value)) if isinstance(value, Const) else Print(value)
    if isinstance(node, If):
        branches, other = [], fold(node.other, filters)
        for test, body in node.branches:
            test, body = fold(test, filters), fold(body, filters)
            if isinstance(test, Const) and test.value:
                other = body
                break
            if not isinstance(test, Const):
                branches.append((test, body))
        return If(tuple(branches), other) if branches else other
    if isinstance(node, For):
        return For(node.name, fold(node.values, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value, filters))
    return node


@dataclass
class Rendered:
    """Text parts, their length so far and the spans (code points) that the generation markers cover."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        value, key = _value(node.value, filters), _value(node.key, filters)
        return lambda env: _item(value(env), key(env))
    args = [_value(a, filters) for a in node.args]
    if node.name in ("and", "or"):
        left, right = args
        return (lambda env: left(env) and right(env)) if node.name == "and" else (lambda env: left(env) or right(env))
    op = _operator(node.name, filters)
    if len(args) == 1:
        one = args[0]
        return lambda env: op(one(env))
    if len(args) == 2:
        one, two = args
        return lambda env: op(one(env), two(env))
    return lambda env: op(*(a(env) for a in args))


def _block(body: tuple, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    steps = [_statement(x, filters) for x in body]

    def run(env: dict, out: Rendered) -> None:
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def _statement(node: Any, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    if isinstance(node, Text):
        return lambda env, out, t=node.value: out.add(t)
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda env, out: out.add(_show(value(env)))
    if isinstance(node, Assign):
        value = _value(node.value, filters)
        return lambda env, out: env.__setitem__(node.name, value(env))
    if isinstance(node, Generation):
        body = _block(node.body, filters)

        def generation(env: dict, out: Rendered) -> None:
            start = out.length
            body(env, out)
            if out.length > start:
                out.spans.append((start, out.length))

        return generation
    if isinstance(node, If):
        branches, other = [(_value(t, filters), _block(b, filters)) for t, b in node.branches], _block(node.other, filters)

        def choose(env: dict, out: Rendered) -> None:
            for test, body in branches:
                if test(env):
                    return body(env, out)
            return other(env, out)

        return choose
    values, body = _value(node.values, filters), _block(node.body, filters)

    def loop(env: dict, out: Rendered) -> None:
        items = values(env)
        if not isinstance(items, list):
            raise TemplateError("only lists can be looped over")
        inner = dict(env)
        for i, item in enumerate(items):
            inner[node.name] = item
            inner["loop"] = {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}
            body(inner, out)

    return loop


def compile_template(source: str, control: tuple[str, ...] = ()) -> tuple[Callable[[dict], Rendered], Escape]:
    """(render, escape): render(names) gives the text and its generation spans; `| escape` guards the control strings."""
    escape = Escape(control)
    filters = {**FILTERS, "escape": escape}
    body = _block(fold(parse(source, filters), filters), filters)

    def render(names: dict) -> Rendered:
        out = Rendered()
        body(dict(names), out)
        return out

    return render, escape
