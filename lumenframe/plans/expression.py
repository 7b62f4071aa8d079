"""Scalar expressions inside { } of the command language, evaluated at plan time."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

_TOKEN = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|("[^"]*"|'[^']*')|([A-Za-z_][\w:]*)|(<=>|<=|>=|==|!=|&&|\|\||//|[-+*/%()<>!,.\[\]&|]))""")

Value = float | int | str


class Expression:
    """Recursive descent over: or, and, comparison, sum, product, unary, atom with .meta and [meta]."""

    def __init__(self, text: str, lookup: Callable[[str, list], Value]):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r}")
            kind = ("number", "string", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at, self.lookup = 0, lookup

    def take(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def evaluate(self) -> Value:
        out = self.either()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Value:
        out = self.both()
        while self.take("||", "|"):
            right = self.both()
            out = int(bool(out) or bool(right))
        return out

    def both(self) -> Value:
        out = self.comparison()
        while self.take("&&", "&"):
            right = self.comparison()
            out = int(bool(out) and bool(right))
        return out

    def comparison(self) -> Value:
        out = self.sum()
        while op := self.take("<=>", "<=", ">=", "==", "!=", "<", ">"):
            right = self.sum()
            if isinstance(out, str) != isinstance(right, str):
                out, right = str(out), str(right)
            out = {"<=>": (out > right) - (out < right), "<=": out <= right, ">=": out >= right, "==": out == right, "!=": out != right, "<": out < right, ">": out > right}[op]
            out = int(out)
        return out

    def sum(self) -> Value:
        out = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            out = out + right if op == "+" else out - right
        return out

    def product(self) -> Value:
        out = self.unary()
        while op := self.take("*", "//", "/", "%"):
            right = self.unary()
            if op == "*":
                out = out * right
            elif not right:
                out = 0
            elif op == "/":
                out = out / right
            else:  # as whole numbers, cut towards zero
                a, b = int(out), int(right)
                out = int(a / b) if op == "//" else int(math.fmod(a, b))
        return out

    def unary(self) -> Value:
        if self.take("-"):
            return -self.unary()
        if self.take("+"):
            return self.unary()
        if self.take("!"):
            return int(not self.unary())
        return self.atom()

    def atom(self) -> Value:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise ValueError("missing )")
            return out
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "number":
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "string":
            return text[1:-1]
        if kind != "name":
            raise ValueError(f"unexpected {text or 'end'!r}")
        if self.take("("):
            args = []
            while not self.take(")"):
                # The first argument of these is a name, not its value.
                bare = text in ("var", "getattribute") and not args and self.tokens[self.at][0] == "name"
                args.append(self._name() if bare else self.either())
                self.take(",")
            return self.call(text, args)
        path: list = []
        while sign := self.take(".", "["):
            if sign == ".":
                path.append(self.tokens[self.at][1])
                self.at += 1
            else:
                path.append([self.either() if self.tokens[self.at][0] != "name" else self._name()])
                if not self.take("]"):
                    raise ValueError("missing ]")
        return self.lookup(text, path)

    def _name(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def call(self, name: str, args: list[Value]) -> Value:
        if name == "eq":
            return int(str(args[0]) == str(args[1]))
        if name == "neq":
            return int(str(args[0]) != str(args[1]))
        if name == "not":
            return int(not args[0])
        if name in ("var", "getattribute"):
            try:
                return self.lookup(name, [str(args[0])])
            except KeyError:
                return args[1] if len(args) > 1 else ""
        raise ValueError(f"unknown function {name}()")


def number(text: str) -> Value:
    """A variable's text as the number that it is, else as itself."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def substitute(text: str, lookup: Callable[[str, list], Value]) -> str:
    """text with each { } replaced by its value."""
    show = lambda v: f"{v:g}" if isinstance(v, float) else str(v)
    return re.sub(r"\{([^{}]*)\}", lambda m: show(Expression(m[1], lookup).evaluate()), text)
