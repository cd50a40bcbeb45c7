"""Column expressions put together as SQL text.

Deeply nested expressions cost one gateway call for every node when they are built from columns; as
text they cost one call in all. The names are those of ``pyspark.sql.functions``: ``sqlx.length(c)`` gives
the text ``length(c)``. Python values are literals, so columns are named by :func:`col`.
"""

from __future__ import annotations

import inspect
import itertools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_numbers = itertools.count()


class E:
    """Text of an expression."""

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    def column(self) -> Column:
        return F.expr(self.text)

    def _two(self, sign: str, other) -> E:
        return E(f"({self.text} {sign} {sql(other)})")

    __add__, __sub__, __mul__ = (lambda s, o, t=t: s._two(t, o) for t in "+-*")
    __truediv__, __mod__ = (lambda s, o, t=t: s._two(t, o) for t in "/%")
    __eq__, __ne__ = (lambda s, o, t=t: s._two(t, o) for t in ("=", "<>"))
    __lt__, __le__, __gt__, __ge__ = (lambda s, o, t=t: s._two(t, o) for t in ("<", "<=", ">", ">="))
    __and__, __or__ = (lambda s, o, t=t: s._two(t, o) for t in ("AND", "OR"))
    __hash__ = None

    def __invert__(self) -> E:
        return E(f"(NOT {self.text})")

    def __neg__(self) -> E:
        return E(f"(- {self.text})")

    def __getitem__(self, field: str) -> E:
        return E(f"{self.text}.`{field}`")

    def alias(self, name: str) -> E:
        return E(self.text, name)

    def cast(self, kind: str) -> E:
        return E(f"CAST({self.text} AS {kind})")

    def try_cast(self, kind: str) -> E:
        return E(f"TRY_CAST({self.text} AS {kind})")

    def isNull(self) -> E:
        return E(f"({self.text} IS NULL)")

    def isNotNull(self) -> E:
        return E(f"({self.text} IS NOT NULL)")

    def between(self, low, high) -> E:
        return E(f"({self.text} BETWEEN {sql(low)} AND {sql(high)})")

    def isin(self, *values) -> E:
        return E(f"({self.text} IN ({', '.join(map(sql, values))}))")

    def rlike(self, pattern: str) -> E:
        return call("rlike", self, pattern)

    def startswith(self, other) -> E:
        return call("startswith", self, other)

    def bitwiseAND(self, other) -> E:
        return self._two("&", other)


class When(E):
    def __init__(self, pairs: list[tuple[E, object]]):
        self.pairs = pairs
        super().__init__("CASE " + " ".join(f"WHEN {sql(c)} THEN {sql(v)}" for c, v in pairs) + " END")

    def when(self, condition: E, value) -> When:
        return When([*self.pairs, (condition, value)])

    def otherwise(self, value) -> E:
        return E(self.text[:-4] + f" ELSE {sql(value)} END")


def sql(value) -> str:
    """Text of an expression or of a Python value."""
    if isinstance(value, E):
        return value.text
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "true", False: "false"}[value]
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return f"{value}L" if abs(value) > 2**31 - 1 else str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lit(value) -> E:
    return E(sql(value))


def col(name: str) -> E:
    return E(".".join(f"`{part}`" for part in name.split(".")))


def when(condition: E, value) -> When:
    return When([(condition, value)])


def struct(*fields: E) -> E:
    return E("named_struct(" + ", ".join(f"'{f.name}', {f.text}" for f in fields) + ")")


def rtrim(value: E, characters: str) -> E:
    return E(f"TRIM(TRAILING {sql(characters)} FROM {value.text})")


def const(value, ddl: str) -> E:
    """Nested Python value as a constant of type ``ddl``."""
    return call("from_json", json.dumps(value, ensure_ascii=False), ddl)


def _lambda(function) -> str:
    names = [f"v{next(_numbers)}" for _ in inspect.signature(function).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {sql(function(*map(E, names)))}"


def call(name: str, *args) -> E:
    """A function of the given name; Python functions become lambdas."""
    return E(f"{name}({', '.join(_lambda(a) if callable(a) and not isinstance(a, E) else sql(a) for a in args)})")


def __getattr__(name: str):
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: call(name, *args)
