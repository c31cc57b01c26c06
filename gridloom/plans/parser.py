"""The script language: assignments and expressions of functions, operators, literals, variables and [resources].

Statements end at `;` or at line ends outside of brackets; `#` starts a comment. Precedence climbs from || through &&,
|, ^, &, equality, comparison, sums, products and ** to unary operators; all but ** group from the left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Literal:
    value: float | str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Resource:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


Node = Literal | Name | Resource | Call | Assign

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<string>"[^"]*"|'[^']*')|(?P<resource>\[[^\]]*\])|(?P<word>[A-Za-z_][A-Za-z_0-9]*)"""
    r"""|(?P<op>\*\*|\|\||&&|==|!=|<>|>=|<=|[-+*/()<>=,!~&|^]))"""
)
_LEVELS = [["||", "or"], ["&&", "and"], ["|"], ["^"], ["&"], ["==", "!=", "<>", "eq", "ne"], ["<", "<=", ">", ">=", "lt", "le", "gt", "ge"], ["+", "-"], ["*", "/", "div"]]
_BINDS = {op: k for k, ops in enumerate(_LEVELS) for op in ops}


def statements(script: str) -> list[str]:
    """Statements without comments; a line goes on while a bracket is open."""
    out, now, quote, depth = [], "", "", 0
    for line in script.splitlines():
        for k, c in enumerate(line):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "#":
                break
            elif c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == ";":
                out.append(now)
                now = ""
                continue
            now += c
        if quote:
            raise ParseError(f"a quote is not closed: {line.strip()!r}")
        if depth <= 0:
            out.append(now)
            now = ""
        else:
            now += " "
    return [s.strip() for s in [*out, now] if s.strip()]


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"can't read {text[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.t, self.k = text, tokens(text), 0

    def peek(self) -> str:
        return self.t[self.k][1] if self.k < len(self.t) else ""

    def next(self) -> tuple[str, str]:
        if self.k >= len(self.t):
            raise ParseError(f"ends too early: {self.text!r}")
        self.k += 1
        return self.t[self.k - 1]

    def need(self, op: str) -> None:
        if self.next()[1] != op:
            raise ParseError(f"{op!r} is missing in {self.text!r}")

    def statement(self) -> Node:
        if len(self.t) > 1 and self.t[0][0] == "word" and self.t[1] == ("op", "="):
            self.k = 2
            out: Node = Assign(self.t[0][1], self.expression(0))
        else:
            out = self.expression(0)
        if self.k < len(self.t):
            raise ParseError(f"unexpected {self.peek()!r} in {self.text!r}")
        return out

    def expression(self, level: int) -> Node:
        left = self.unary()
        while True:
            kind = self.t[self.k][0] if self.k < len(self.t) else ""
            op = self.peek().lower()
            bind = _BINDS.get(op, -1) if kind in ("op", "word") else -1
            if bind < level:
                return left
            self.k += 1
            left = Call(op, (left, self.expression(bind + 1)))

    def unary(self) -> Node:
        op = self.peek()
        if self.k < len(self.t) and self.t[self.k][0] in ("op", "word") and op in ("-", "+", "!", "~", "not"):
            self.k += 1
            x = self.unary()
            if op == "+":
                return x
            if op == "-" and isinstance(x, Literal) and not isinstance(x.value, str):
                return Literal(-x.value)
            return Call({"-": "uminus", "not": "!"}.get(op, op), (x,))
        return self.power()

    def power(self) -> Node:
        x = self.atom()
        if self.peek() == "**":
            self.k += 1
            return Call("**", (x, self.unary()))
        return x

    def atom(self) -> Node:
        kind, s = self.next()
        if kind == "number":
            return Literal(float(s))
        if kind == "string":
            return Literal(s[1:-1])
        if kind == "resource":
            return Resource(s[1:-1].strip())
        if s == "(":
            x = self.expression(0)
            self.need(")")
            return x
        if kind != "word":
            raise ParseError(f"unexpected {s!r} in {self.text!r}")
        if self.peek() == "(":
            self.k += 1
            args = []
            if self.peek() != ")":
                args.append(self.expression(0))
                while self.peek() == ",":
                    self.k += 1
                    args.append(self.expression(0))
            self.need(")")
            return Call(s.lower(), tuple(args))
        low = s.lower()
        if low == "nan":
            return Literal(float("nan"))
        if low in ("true", "false"):
            return Literal(float(low == "true"))
        return Name(s)


def parse(script: str) -> list[Node]:
    """One tree for each statement. Names of functions can't be assigned; unknown functions are errors."""
    from .registry import lookup

    out, known = [], set()

    def check(x) -> None:
        if isinstance(x, Call):
            if lookup(x.name) is None:
                raise ParseError(f"unknown function {x.name!r}")
            for a in x.args:
                check(a)
        elif isinstance(x, Name) and x.name not in known:
            raise ParseError(f"{x.name!r} is not defined")

    for s in statements(script):
        x = _Parser(s).statement()
        if isinstance(x, Assign):
            if lookup(x.name) is not None:
                raise ParseError(f"{x.name!r} is a function")
            check(x.value)
            known.add(x.name)
        else:
            check(x)
        out.append(x)
    if not out:
        raise ParseError("the script is empty")
    return out
