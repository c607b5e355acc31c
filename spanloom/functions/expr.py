"""Writing SQL expressions from Python.

The tree functions are long expressions, and a PySpark ``Column`` costs a round
trip to the JVM for every operator in it: seconds for one decoded tree.  Here an
expression is plain SQL text, put together in Python and handed over once, as
:attr:`Expr.column`.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


def _quote(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(c if c >= " " else f"\\u{ord(c):04x}" for c in escaped) + "'"


def sql(value: object) -> str:
    """SQL text of an expression or literal."""
    if isinstance(value, Expr):
        return value.text
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return _quote(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    raise TypeError(f"no SQL literal for {value!r}")


class Expr:
    """An SQL expression; operators work as they do on columns."""

    def __init__(self, text: str):
        self.text = text

    @property
    def column(self) -> Column:
        return F.expr(self.text)

    def __repr__(self) -> str:
        return f"Expr({self.text})"

    __hash__ = None

    def _infix(self, operator: str, other: object) -> Expr:
        return Expr(f"({self.text} {operator} {sql(other)})")

    def __eq__(self, other):
        return self._infix("=", other)

    def __ne__(self, other):
        return self._infix("!=", other)

    def __lt__(self, other):
        return self._infix("<", other)

    def __gt__(self, other):
        return self._infix(">", other)

    def __ge__(self, other):
        return self._infix(">=", other)

    def __add__(self, other):
        return self._infix("+", other)

    def __sub__(self, other):
        return self._infix("-", other)

    def __mul__(self, other):
        return self._infix("*", other)

    def __and__(self, other):
        return self._infix("AND", other)

    def __or__(self, other):
        return self._infix("OR", other)

    def __invert__(self):
        return Expr(f"(NOT {self.text})")

    def __getitem__(self, field: str) -> Expr:
        plain = self.text.replace("_", "a").replace("`", "a").replace(".", "a").isalnum()
        return Expr(f"{self.text if plain else f'({self.text})'}.{field}")

    def is_null(self) -> Expr:
        return Expr(f"({self.text} IS NULL)")

    def is_not_null(self) -> Expr:
        return Expr(f"({self.text} IS NOT NULL)")

    def isin(self, *values: object) -> Expr:
        return Expr(f"({self.text} IN ({', '.join(map(sql, values))}))") if values else Expr("false")

    def cast(self, type_: str) -> Expr:
        return Expr(f"cast({self.text} AS {type_})")

    def try_cast(self, type_: str) -> Expr:
        return Expr(f"try_cast({self.text} AS {type_})")

    def startswith(self, other) -> Expr:
        return S.startswith(self, other)

    def endswith(self, other) -> Expr:
        return S.endswith(self, other)

    def contains(self, other) -> Expr:
        return S.contains(self, other)

    def rlike(self, pattern) -> Expr:
        return S.rlike(self, pattern)


class Case(Expr):
    """``CASE WHEN … END``; NULL where no condition holds."""

    def __init__(self, branches: tuple[tuple[object, object], ...]):
        self.branches = branches
        super().__init__(self._text(""))

    def _text(self, rest: str) -> str:
        whens = " ".join(f"WHEN {sql(c)} THEN {sql(v)}" for c, v in self.branches)
        return f"(CASE {whens}{rest} END)"

    def when(self, condition: object, value: object) -> Case:
        return Case((*self.branches, (condition, value)))

    def otherwise(self, value: object) -> Expr:
        return Expr(self._text(f" ELSE {sql(value)}"))


class _Functions:
    """``S.name(args…)`` calls the SQL function ``name``; a Python function becomes a lambda."""

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        def call(*args: object) -> Expr:
            return Expr(f"{name}({', '.join(map(self._argument, args))})")

        return call

    @staticmethod
    def _argument(value: object) -> str:
        if not inspect.isfunction(value):
            return sql(value)
        names = [f"v{next(_names)}" for _ in inspect.signature(value).parameters]
        body = value(*[Expr(name) for name in names])
        head = names[0] if len(names) == 1 else f"({', '.join(names)})"
        return f"{head} -> {sql(body)}"

    @staticmethod
    def col(name: str) -> Expr:
        return Expr(f"`{name}`")

    @staticmethod
    def lit(value: object) -> Expr:
        return Expr(sql(value))

    @staticmethod
    def when(condition: object, value: object) -> Case:
        return Case(((condition, value),))

    @staticmethod
    def struct(**fields: object) -> Expr:
        return Expr(f"named_struct({', '.join(f'{_quote(n)}, {sql(v)}' for n, v in fields.items())})")


S = _Functions()


def expr(value: Expr | str) -> Expr:
    """An expression, from one or from a column name."""
    return value if isinstance(value, Expr) else S.col(value)


def column(value: Expr | Column) -> Column:
    return value.column if isinstance(value, Expr) else value


def let(value: Expr, body: Callable[[Expr], Expr]) -> Expr:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    name = f"v{next(_names)}"
    return Expr(f"get(transform(array({value.text}), {name} -> {sql(body(Expr(name)))}), 0)")
