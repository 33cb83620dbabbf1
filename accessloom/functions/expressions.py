"""A small expression language over records, compiled to columns.

Literals, the variables it is given, ==, !=, <, <=, >, >=, &&, ||, !, in, + (texts or numbers), x[key] and the methods contains, startsWith,
endsWith, matches and size. A row for which an expression can't be evaluated (say, a key that is not there) yields null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|&&|\|\||[-<>!()\[\],.+]))""")
_BINDS = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4}


class ExpressionError(ValueError):
    pass


def tokenise(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str, variables: dict[str, Column]):
        self.rest, self.variables = tokenise(text), variables

    def next(self) -> tuple[str, str]:
        return self.rest.pop(0)

    def expect(self, value: str) -> None:
        kind, got = self.next()
        if got != value:
            raise ExpressionError(f"expected {value}, got {got or kind}")

    def whole(self) -> Column:
        out = self.binary(0)
        if self.rest[0][0] != "end":
            raise ExpressionError(f"unexpected {self.rest[0][1]}")
        return out

    def binary(self, least: int) -> Column:
        left = self.unary()
        while (level := _BINDS.get(self.rest[0][1], 0)) > least and self.rest[0][0] in ("op", "name"):
            op = self.next()[1]
            right = self.binary(level)
            left = self.combined(op, left, right)
        return left

    @staticmethod
    def combined(op: str, a: Column, b: Column) -> Column:
        if op == "in":
            return F.array_contains(b, a)
        if op == "+":
            return F.concat(a, b)
        return {"||": a.__or__, "&&": a.__and__, "==": a.__eq__, "!=": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)

    def unary(self) -> Column:
        if self.rest[0] == ("op", "!"):
            self.next()
            return ~self.unary()
        if self.rest[0] == ("op", "-"):
            self.next()
            return -self.unary()
        return self.postfix(self.atom())

    def atom(self) -> Column:
        kind, value = self.next()
        if kind == "number":
            return F.lit(float(value) if "." in value else int(value))
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "name":
            if value in ("true", "false"):
                return F.lit(value == "true")
            while value not in self.variables and self.rest[0] == ("op", ".") and any(v.startswith(value + ".") for v in self.variables):
                self.next()
                value = f"{value}.{self.next()[1]}"
            if value not in self.variables:
                raise ExpressionError(f"unknown variable {value}")
            return self.variables[value]
        if value == "(":
            out = self.binary(0)
            self.expect(")")
            return out
        if value == "[":
            items = self.arguments("]")
            return F.array(*items)
        raise ExpressionError(f"unexpected {value or kind}")

    def arguments(self, end: str) -> list[Column]:
        out = []
        while self.rest[0][1] != end:
            out.append(self.binary(0))
            if self.rest[0][1] == ",":
                self.next()
        self.expect(end)
        return out

    def postfix(self, value: Column) -> Column:
        while self.rest[0] in (("op", "["), ("op", ".")):
            if self.next()[1] == "[":
                key = self.binary(0)
                self.expect("]")
                value = F.try_element_at(value, key)
                continue
            name = self.next()[1]
            if self.rest[0] != ("op", "("):
                value = F.try_element_at(value, F.lit(name))
                continue
            self.next()
            args = self.arguments(")")
            calls = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike, "size": lambda x: F.length(x)}
            if name not in calls:
                raise ExpressionError(f"unknown method {name}")
            value = calls[name](value, *args)
        return value


def compiled(text: str, variables: dict[str, Column]) -> Column:
    return Parser(text, variables).whole()
