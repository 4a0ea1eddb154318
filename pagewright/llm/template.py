"""A small sandboxed template language, compiled to Python closures.

``{{ value }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in list %} {% endfor %}`` (with ``loop.first``,
``loop.last``, ``loop.index``), ``{% set x = value %}`` and ``{% generation %} {% endgeneration %}``, which marks what it renders. Values:
names, keys of mappings (``m.role`` or ``m["role"]``), texts, whole numbers, true, false, none, ``== != in and or not ~`` and filters.

The sandbox is the language: no calls, no Python attributes, no names but those given. Source becomes a syntax tree,
constants are folded in it, and each node left becomes one closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

PART = re.compile(r"\{%(-?)\s*(.*?)\s*(-?)%\}|\{\{(-?)\s*(.*?)\s*(-?)\}\}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>\d+)|(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<sign>==|!=|[~|.()\[\]=]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """A template that cannot be parsed, or that asks for what the sandbox does not hold."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Values:
    """Reads one value from tokens: or < and < not < comparison < ~ < filter < key."""

    def __init__(self, source: str, filters: Mapping):
        self.tokens, self.at, self.filters = _tokens(source), 0, filters

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else ""

    def take(self, *signs: str) -> str:
        if self.peek() in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"expected {sign!r}")

    def whole(self):
        value = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"did not expect {self.tokens[self.at][1]!r}")
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Op("or", (value, self.both()))
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Op("and", (value, self.negated()))
        return value

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        while sign := self.take("==", "!=", "in"):
            value = Op(sign, (value, self.joined()))
        return value

    def joined(self):
        value = self.filtered()
        while self.take("~"):
            value = Op("~", (value, self.filtered()))
        return value

    def filtered(self):
        value = self.keyed()
        while self.take("|"):
            name = self.peek()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Op(f"|{name}", (value,))
        return value

    def keyed(self):
        value = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    raise TemplateError("expected a key after '.'")
                value = Item(value, Const(self.tokens[self.at][1]))
                self.at += 1
            else:
                value = Item(value, self.either())
                self.need("]")
        return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(int(text))
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else Name(text)
        if text == "(":
            value = self.either()
            self.need(")")
            return value
        raise TemplateError(f"did not expect {text!r}")


def _pieces(source: str) -> list[tuple[str, str]]:
    out, at, trim = [], 0, False
    for m in PART.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if trim else text
        if m[1] or m[4]:
            text = text.rstrip()
        out += [("text", text)] * bool(text) + [("do", m[2]) if m[2] is not None else ("show", m[5])]
        trim, at = bool(m[3] or m[6]), m.end()
    text = source[at:]
    text = text.lstrip() if trim else text
    return out + [("text", text)] * bool(text)


def parse(source: str, filters: Mapping) -> tuple:
    """The syntax tree of a template."""
    pieces, at = _pieces(source), 0

    def value(text: str):
        return _Values(text, filters).whole()

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                out.append(Emit(Const(text)))
                continue
            if kind == "show":
                out.append(Emit(value(text)))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), text
            if word == "if":
                out.append(branch(rest))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {text!r}")
                out.append(For(m[1], value(m[2]), body("endfor")[0]))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {text!r}")
                out.append(Set(m[1], value(m[2])))
            elif word == "generation":
                out.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"did not expect {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(test: str):
        then, end = body("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        if word == "elif":
            return If(value(test), then, (branch(rest),))
        return If(value(test), then, body("endif")[0] if word == "else" else ())

    return body()[0]


def _text(v: object) -> str:
    if v is None:
        return ""
    return v if isinstance(v, str) else ("true" if v is True else "false" if v is False else str(v)) if isinstance(v, (bool, int)) else _refuse(v)


def _refuse(v: object):
    raise TemplateError(f"a {type(v).__name__} cannot be shown")


PLAIN: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a,
    "in": lambda a, b: a in b if isinstance(b, (str, tuple, list, Mapping)) else _refuse(b),
}


def fold(node, filters: Mapping):
    """The tree with constant parts worked out, dead branches gone and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(x, filters) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    y = Emit(Const(_text(y.value.value)))
                    if not y.value.value:
                        continue
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        y = Emit(Const(out.pop().value.value + y.value.value))
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.sign == "and") else args[0]
        if all(isinstance(a, Const) for a in args) and node.sign not in ("and", "or"):
            return Const(_function(node.sign, filters)(*[a.value for a in args]))
        return Op(node.sign, args)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Emit):
        return Emit(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def _function(sign: str, filters: Mapping) -> Callable:
    return filters[sign[1:]] if sign.startswith("|") else PLAIN[sign]


@dataclass
class Page:
    """What has been rendered: pieces, their length in characters, and the marked spans."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node, filters: Mapping) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        def look(env: dict, name=node.name):
            if name not in env:
                raise TemplateError(f"no name {name!r}")
            return env[name]
        return look
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(env: dict):
            held, k = of(env), key(env)
            if isinstance(held, Mapping):
                return held.get(k)
            if isinstance(held, (list, tuple)) and isinstance(k, int) and not isinstance(k, bool):
                return held[k] if k < len(held) else None
            raise TemplateError(f"{k!r} is not a key here")
        return item
    args = [_value(a, filters) for a in node.args]
    if node.sign == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.sign == "or":
        return lambda env: args[0](env) or args[1](env)
    fn = _function(node.sign, filters)
    if len(args) == 1:
        return lambda env, a=args[0]: fn(a(env))
    return lambda env, a=args[0], b=args[1]: fn(a(env), b(env))


def _block(nodes: tuple, filters: Mapping) -> Callable[[dict, Page], None]:
    steps = [_step(n, filters) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, page: Page) -> None:
        for s in steps:
            s(env, page)
    return run


def _step(node, filters: Mapping) -> Callable[[dict, Page], None]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            return lambda env, page, text=node.value.value: page.add(text)
        value = _value(node.value, filters)
        return lambda env, page: page.add(_text(value(env)))
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def put(env: dict, page: Page) -> None:
            env[node.name] = value(env)
        return put
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _block(node.then, filters), _block(node.other, filters)
        return lambda env, page: then(env, page) if test(env) else other(env, page)
    if isinstance(node, Generation):
        body = _block(node.body, filters)

        def mark(env: dict, page: Page) -> None:
            start = page.size
            body(env, page)
            page.spans.append((start, page.size))
        return mark
    over, body = _value(node.over, filters), _block(node.body, filters)

    def each(env: dict, page: Page) -> None:
        items = over(env)
        if not isinstance(items, (list, tuple)):
            raise TemplateError("only a list can be walked")
        inner = dict(env)
        for i, x in enumerate(items):
            inner[node.name] = x
            inner["loop"] = {"first": i == 0, "last": i == len(items) - 1, "index": i + 1}
            body(inner, page)
    return each


def compiled(source: str, filters: Mapping | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """``render(names)`` gives the text and the spans marked as generation."""
    known = {"trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v)} | dict(filters or {})
    run = _block(fold(parse(source, known), known), known)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        page = Page()
        run(dict(names), page)
        return "".join(page.parts), page.spans
    return render
