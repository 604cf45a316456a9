"""Query text to syntax trees.

A tree is a tuple whose first item names it: ("num", 1), ("str", "x"), ("name", "data"), ("var", "*A"), ("hole", value),
("get", base or None, key), ("maybe", get), ("call", head, [arguments]), ("op", "+", left, right), ("pipe", value, function),
("object", [(key, value)]), ("array", [items]), ("let", name, parameters, value, body), ("fn", name, body).

An argument of an application reaches over every operator but the pipe, so ``sum c & x`` is ``sum (c & x)``. ``a * b`` and
``a*b`` multiply; in ``f a *b`` the star begins a variable.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

# Binding strength of the language's operators, loosest first; all associate to the left.
STRENGTH = {"|": 40, "&": 50, "||": 70, "&&": 80, "<": 90, "<=": 90, ">": 90, ">=": 90, "==": 90, "!=": 90, "::": 95, "+": 100, "-": 100, "*": 200, "/": 200, "//": 200, "%": 200}
ARGUMENT = 50
_TOKEN = re.compile(
    r"""(?P<gap>(?:\s|\#[^\n]*)*)(?:
      (?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<hole>@[A-Za-z_]\w*)|(?P<name>[A-Za-z_$]\w*)
      |(?P<sign>\|\||&&|==|!=|<=|>=|::|//|\*\*|[-+*/%<>=|&.,:;?(){}\[\]])|(?P<end>$))""",
    re.X,
)


class QuerySyntaxError(ValueError):
    """Query text that cannot be parsed, with the place where it stopped."""


def tokens(text: str) -> list[tuple[str, str, str]]:
    """(kind, text, gap before) of every token; variables are single tokens."""
    out, at = [], 0
    while not out or out[-1][0] != "end":
        m = _TOKEN.match(text, at)
        if m is None:
            raise QuerySyntaxError(f"unexpected {text[at : at + 20]!r} at {at}")
        kind = m.lastgroup if m.lastgroup != "gap" else "end"
        out.append((kind, m[kind], m["gap"]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str, holes: dict[str, Any] | None = None):
        self.text, self.holes, self.tokens, self.at = text, holes or {}, tokens(text), 0
        self.line_ends = False  # whether a new line ends the arguments of an application

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def word(self) -> str:
        return self.tokens[self.at][1]

    @property
    def gap(self) -> str:
        return self.tokens[self.at][2]

    def take(self, expected: str | None = None) -> str:
        word = self.word
        if expected is not None and word != expected:
            raise QuerySyntaxError(f"{expected!r} expected, {word!r} found in {self.text!r}")
        self.at += 1
        return word

    def parse(self):
        tree = self.expression()
        if self.kind != "end":
            raise QuerySyntaxError(f"could not parse from {self.word!r} in {self.text!r}")
        return tree

    def expression(self):
        if self.kind == "name" and self.word == "let":
            self.take()
            name, parameters = self.take(), []
            while self.kind == "name":
                parameters.append(self.take())
            self.take("=")
            outside, self.line_ends = self.line_ends, True
            value = self.operators(0, self.application)
            self.line_ends = outside
            if self.word == ";":
                self.take()
            elif "\n" not in self.gap:
                raise QuerySyntaxError("a let ends with ';' or a new line")
            return ("let", name, parameters, value, self.expression())
        return self.operators(0, self.application)

    def operators(self, least: int, operand):
        left = operand()
        while self.kind == "sign" and STRENGTH.get(self.word, -1) >= least and not self.variable_follows():
            sign = self.take()
            right = self.operators(STRENGTH[sign] + 1, operand)
            left = ("pipe", left, right) if sign == "|" else ("op", sign, left, right)
        return left

    def variable_follows(self) -> bool:
        """``f x *y``: a star with space before it and a name right behind it begins a variable."""
        following = self.tokens[self.at + 1 : self.at + 2]
        return self.word == "*" and self.gap != "" and bool(following) and following[0][0] == "name" and following[0][2] == ""

    def starts_operand(self) -> bool:
        return self.kind in ("num", "str", "hole", "name") or self.word in ("*", "**", ".", "(", "[", "{") and self.kind == "sign"

    def application(self):
        head = self.operators(ARGUMENT, self.path)
        arguments = []
        while self.starts_operand() and not (self.line_ends and "\n" in self.gap):
            arguments.append(self.operators(ARGUMENT, self.path))
        return ("call", head, arguments) if arguments else head

    def inside(self, parse: Callable):
        """Within brackets, lines do not matter."""
        outside, self.line_ends = self.line_ends, False
        tree, self.line_ends = parse(), outside
        return tree

    def path(self):
        if self.word == "." and self.kind == "sign":
            self.take()
            tree = ("get", None, self.atom())
        else:
            tree = self.atom()
        tree = self.optional(tree)
        while self.gap == "" and self.kind == "sign" and self.word in (".", "(", "["):
            sign = self.take()
            if sign == ".":
                tree = self.optional(("get", tree, self.atom()))
            elif sign == "(":
                inner = [] if self.word == ")" else self.inside(lambda: self.list_of(")"))
                self.take(")")
                tree = ("call", tree, inner)
            else:
                tree = ("get", tree, self.inside(self.expression))
                self.take("]")
        return tree

    def optional(self, tree):
        if self.gap == "" and self.word == "?" and self.kind == "sign":
            self.take()
            return ("maybe", tree)
        return tree

    def list_of(self, end: str) -> list:
        items = []
        while self.word != end:
            items.append(self.expression())
            if self.word != ",":
                break
            self.take()
        return items

    def atom(self):
        kind, word = self.kind, self.word
        if kind == "num":
            self.take()
            return ("num", float(word) if "." in word else int(word))
        if kind == "str":
            self.take()
            return ("str", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1]))
        if kind == "hole":
            self.take()
            if word[1:] not in self.holes:
                raise QuerySyntaxError(f"nothing given for {word}")
            return ("hole", self.holes[word[1:]])
        if kind == "name":
            self.take()
            if word == "fn":
                return ("fn", self.take(), self.operators(ARGUMENT, self.path))
            return ("name", word)
        if word in ("*", "**"):
            self.take()
            return ("var", word + self.take() if self.kind == "name" and self.gap == "" else word)
        if word == "(":
            self.take()
            tree = self.inside(self.expression)
            self.take(")")
            return tree
        if word == "[":
            self.take()
            items = self.inside(lambda: self.list_of("]"))
            self.take("]")
            return ("array", items)
        if word == "{":
            self.take()
            entries = []
            while self.word != "}":
                key = self.inside(self.expression)
                if self.word == ":":
                    self.take()
                    entries.append((key, self.inside(self.expression)))
                else:
                    entries.append((key, key))
                if self.word != ",":
                    break
                self.take()
            self.take("}")
            return ("object", entries)
        raise QuerySyntaxError(f"operand expected, {word!r} found in {self.text!r}")


def parse(text: str, **holes):
    return Parser(text, holes).parse()
