"""Compiler of a small sandboxed chat template language.

    text {{ expression }} {% for m in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %} {% generation %} ... {% endgeneration %}

Expressions: string literals, names, fields (``m.role``, ``loop.first``, ``loop.index``), ``+``,
``==``, ``!=``, ``not``, ``and``, ``or``, parentheses and filters (``| name``).  There are no
calls, subscripts or attributes of Python objects: a field is a key of a plain dict.  A template
becomes a syntax tree, constants are folded (literals, comparisons and sums of literals, dead
branches, neighbouring texts), and each node becomes a closure.  Closures yield (piece, in
generation), so a conversation is rendered turn by turn however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

Piece = tuple[str, bool]
LEXER = re.compile(r"\s*(?:(?P<string>'[^']*'|\"[^\"]*\")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[+().|]))")
BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*%\}", re.S)
KEYWORDS = {"and", "or", "not"}


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) in order; the last may have Literal(True)


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = LEXER.match(source, at)
            if m is None:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def parse(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "string":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, below: Callable, *signs: str):
        node = below()
        while sign := self.take(*signs):
            node = Op(sign, (node, below()))
        return node

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negation, "and")

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.chain(self.sum, "==", "!=")

    def sum(self):
        return self.chain(self.filtered, "+")

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            node = Op(f"|{self.word()}", (node,))
        return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "string":
            self.at += 1
            return Literal(self.tokens[self.at - 1][1][1:-1])
        path = [self.word()]
        if path[0] in KEYWORDS:
            raise TemplateError(f"unexpected {path[0]!r}")
        while self.take("."):
            path.append(self.word())
        return Literal(path[0] == "true") if path in (["true"], ["false"]) else Name(tuple(path))


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in BLOCK.finditer(source):
        parts += [("text", source[at:m.start()]), ("show", m[1]) if m[1] is not None else ("tag", m[2])]
        at = m.end()
    parts.append(("text", source[at:]))
    parts = [p for p in parts if p != ("text", "")]
    body, rest = _body(parts, ())
    if rest:
        raise TemplateError(f"unexpected tag {rest[0][1]!r}")
    return body


def _body(parts: list, stops: tuple[str, ...]) -> tuple[tuple, list]:
    out = []
    while parts:
        (kind, value), rest = parts[0], parts[1:]
        if kind == "text":
            out.append(Show(Literal(value)))
        elif kind == "show":
            out.append(Show(_Expression(value).parse()))
        else:
            word, _, more = value.partition(" ")
            if word in stops:
                return tuple(out), parts
            node, rest = _tag(word, more, rest)
            out.append(node)
        parts = rest
    if stops:
        raise TemplateError(f"{stops[-1]} is missing")
    return tuple(out), []


def _tag(word: str, more: str, rest: list):
    if word == "generation":
        body, rest = _body(rest, ("endgeneration",))
        return Generation(body), rest[1:]
    if word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", more.strip(), re.S)
        if m is None:
            raise TemplateError(f"cannot read 'for {more}'")
        body, rest = _body(rest, ("endfor",))
        return For(m[1], _Expression(m[2]).parse(), body), rest[1:]
    if word != "if":
        raise TemplateError(f"unknown tag {word!r}")
    branches, condition = [], _Expression(more).parse()
    while True:
        body, rest = _body(rest, ("elif", "else", "endif"))
        branches.append((condition, body))
        (_, tag), rest = rest[0], rest[1:]
        word, _, more = tag.partition(" ")
        if word == "endif":
            return If(tuple(branches)), rest
        condition = Literal(True) if word == "else" else _Expression(more).parse()


def _apply(name: str, filters: dict, args: list):
    match name:
        case "==":
            return args[0] == args[1]
        case "!=":
            return args[0] != args[1]
        case "+":
            return f"{args[0]}{args[1]}"
        case "not":
            return not args[0]
        case "and":
            return args[0] and args[1]
        case "or":
            return args[0] or args[1]
    if name[1:] not in filters:
        raise TemplateError(f"unknown filter {name[1:]!r}")
    return filters[name[1:]](args[0])


def fold(node, filters: dict):
    """The same tree with its constants worked out."""
    if isinstance(node, tuple):
        out = []
        for x in node:
            x = fold(x, filters)
            if not isinstance(x, If):
                out.append(x)
            elif x.branches and isinstance(x.branches[0][0], Literal):
                out += x.branches[0][1]  # always taken: the branches before it were dropped
            elif x.branches:
                out.append(x)
        merged = []
        for x in out:
            if merged and all(isinstance(y, Show) and isinstance(y.value, Literal) for y in (x, merged[-1])):
                merged[-1] = Show(Literal(f"{merged[-1].value.value}{x.value.value}"))
            else:
                merged.append(x)
        return tuple(merged)
    match node:
        case Op(name, args):
            args = tuple(fold(a, filters) for a in args)
            known = all(isinstance(a, Literal) for a in args)
            return Literal(_apply(name, filters, [a.value for a in args])) if known else Op(name, args)
        case Show(value):
            return Show(fold(value, filters))
        case Generation(body):
            return Generation(fold(body, filters))
        case For(name, over, body):
            return For(name, fold(over, filters), fold(body, filters))
        case If(branches):
            kept = []
            for condition, body in branches:
                condition = fold(condition, filters)
                if isinstance(condition, Literal) and not condition.value:
                    continue
                kept.append((condition, fold(body, filters)))
                if isinstance(condition, Literal):
                    break
            if not kept:
                return If(())
            if isinstance(kept[0][0], Literal):
                return If(((kept[0][0], kept[0][1]),))
            return If(tuple(kept))
    return node


def _value(node, filters: dict) -> Callable[[dict], object]:
    match node:
        case Literal(value):
            return lambda scope: value
        case Name(path):
            def look(scope):
                found = scope
                for key in path:
                    if not isinstance(found, dict) or key not in found:
                        raise TemplateError(f"unknown name {'.'.join(path)}")
                    found = found[key]
                return found
            return look
        case Op("and", (a, b)):
            left, right = _value(a, filters), _value(b, filters)
            return lambda scope: left(scope) and right(scope)
        case Op("or", (a, b)):
            left, right = _value(a, filters), _value(b, filters)
            return lambda scope: left(scope) or right(scope)
        case Op(name, args):
            if name[0] == "|" and name[1:] not in filters:
                raise TemplateError(f"unknown filter {name[1:]!r}")
            parts = [_value(a, filters) for a in args]
            return lambda scope: _apply(name, filters, [p(scope) for p in parts])
    raise TemplateError(f"no expression: {node}")


def _step(node, filters: dict, inside: bool) -> Callable[[dict], Iterator[Piece]]:
    match node:
        case Show(value):
            shown = _value(value, filters)

            def show(scope):
                yield str(shown(scope)), inside
            return show
        case Generation(body):
            return _steps(body, filters, True)
        case If(branches):
            tests = [(_value(c, filters), _steps(b, filters, inside)) for c, b in branches]

            def choose(scope):
                for test, body in tests:
                    if test(scope):
                        yield from body(scope)
                        return
            return choose
        case For(name, over, body):
            items, run = _value(over, filters), _steps(body, filters, inside)

            def loop(scope):
                for i, item in enumerate(items(scope)):
                    yield from run({**scope, name: item, "loop": {"index": i + 1, "first": i == 0}})
            return loop
    raise TemplateError(f"no statement: {node}")


def _steps(body: tuple, filters: dict, inside: bool) -> Callable[[dict], Iterator[Piece]]:
    parts = [_step(x, filters, inside) for x in body]

    def run(scope):
        for part in parts:
            yield from part(scope)
    return run


class Template:
    def __init__(self, source: str, filters: dict[str, Callable[[str], str]] | None = None) -> None:
        self.tree = fold(parse(source), filters or {})
        self._run = _steps(self.tree, filters or {}, False)

    def pieces(self, messages: Iterable[dict], **names: object) -> Iterator[Piece]:
        """(text, in generation) pieces in order; ``messages`` is read as they are asked for."""
        return self._run({"messages": messages, **names})

    def render(self, messages: Iterable[dict], **names: object) -> str:
        return "".join(text for text, _ in self.pieces(messages, **names))
