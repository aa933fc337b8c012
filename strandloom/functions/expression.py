"""Arithmetic and boolean expressions over tags, parsed to columns by operator precedence."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.model import ConfigError

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\|\||&&|[<>=!]=|[-+*/%^<>(),!]))")
#: Binding powers, loosest first.
POWERS = {"or": 1, "||": 1, "and": 2, "&&": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "^": 8}
UNARY = 7


def number(c: Column) -> Column:
    return c.cast("double")


def truthy(c: Column) -> Column:
    return c != 0


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "log": lambda base, x=None: F.log(base) / F.log(F.lit(10.0)) if x is None else F.log(x) / F.log(base),
    "e": lambda: F.e(),
    "pi": lambda: F.pi(),
    "int": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)),
    "ceil": F.ceil,
    "floor": F.floor,
    "round": lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5),
    "abs": F.abs,
    "sign": F.signum,
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
}


def operate(op: str, a: Column, b: Column) -> Column:
    if op in ("or", "||"):
        return number(truthy(a) | truthy(b))
    if op in ("and", "&&"):
        return number(truthy(a) & truthy(b))
    if op in POWERS and POWERS[op] in (3, 4):
        return number({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    if op == "^":
        return F.pow(a, b)
    # a quotient by zero is infinite or not a number, as in floating point
    zero = b == 0
    if op == "/":
        return F.when(~zero, F.try_divide(a, b)).otherwise(F.when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf"))))
    if op == "%":
        return F.when(~zero, F.try_mod(a, b)).otherwise(F.lit(float("nan")))
    return {"+": a + b, "-": a - b, "*": a * b}[op]


class Expression:
    """A parsed expression; names: the variables it uses."""

    def __init__(self, text: str):
        self.text, at, self.tokens = text, 0, []
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ConfigError(f"can't read the expression '{text}' at character {at}")
            self.tokens.append(m.group(m.lastindex))
            at = m.end()
        functions = {t for t, after in zip(self.tokens, [*self.tokens[1:], ""], strict=True) if after == "("}
        self.names = sorted({t for t in self.tokens if re.match(r"[A-Za-z_]", t)} - functions - {"and", "or"})

    def column(self, variables: dict[str, Column]) -> Column:
        self._left, self._variables = list(self.tokens), variables
        value = self._parse(0)
        if self._left:
            raise ConfigError(f"'{self._left[0]}' is not expected in the expression '{self.text}'")
        return number(value)

    def _next(self) -> str:
        if not self._left:
            raise ConfigError(f"the expression '{self.text}' ends too early")
        return self._left.pop(0)

    def _parse(self, least: int) -> Column:
        value = self._atom()
        while self._left and POWERS.get(self._left[0], 0) > least:
            op = self._next()
            value = operate(op, value, self._parse(POWERS[op] - (op == "^")))
        return value

    def _atom(self) -> Column:
        t = self._next()
        if t == "-":
            return -self._parse(UNARY)
        if t == "+":
            return self._parse(UNARY)
        if t == "!":
            return number(~truthy(self._parse(UNARY)))
        if t == "(":
            value = self._parse(0)
            self._expect(")")
            return value
        if re.match(r"[\d.]", t):
            return F.lit(float(t))
        if self._left and self._left[0] == "(":
            self._next()
            arguments = []
            while self._left and self._left[0] != ")":
                arguments.append(self._parse(0))
                if self._left and self._left[0] == ",":
                    self._next()
            self._expect(")")
            if t not in FUNCTIONS:
                raise ConfigError(f"unknown function '{t}'")
            return number(FUNCTIONS[t](*arguments))
        if t not in self._variables:
            raise ConfigError(f"unknown variable '{t}'")
        return self._variables[t]

    def _expect(self, token: str) -> None:
        if self._next() != token:
            raise ConfigError(f"'{token}' is missing in the expression '{self.text}'")
