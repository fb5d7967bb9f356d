"""The expression tree.

An ``Expr`` is a value: methods return new ones, and nothing touches Spark until
``operators.resolve`` turns the tree into a ``Column`` against a schema. The
schema is needed because ``year`` depends on its argument's type and because
some window functions need an order column.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

AGGREGATES = ("sum", "min", "max", "mean", "count", "count_distinct", "approx_count_distinct", "std", "var", "first", "last", "median", "collect_list")
ORDERED = ("row_number", "lag", "lead", "cum_sum")
RANKS = ("rank", "dense_rank")


def as_expr(value: Any) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


class Expr:
    __slots__ = ("op", "args", "name")

    def __init__(self, op: str, *args: Any, name: str | None = None):
        self.op, self.args, self.name = op, args, name

    def alias(self, name: str) -> Expr:
        return Expr(self.op, *self.args, name=name)

    def signature(self) -> tuple:
        """A hashable structural form; the alias is not part of it."""
        form = lambda a: a.signature() if isinstance(a, Expr) else tuple(map(form, a)) if isinstance(a, (list, tuple)) else a
        return (self.op, *map(form, self.args))

    def __hash__(self) -> int:
        return hash((self.signature(), self.name))

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; combine conditions with &, | and ~")

    def __repr__(self) -> str:
        inner = f"{self.op}({', '.join(map(repr, self.args))})"
        return f"{inner} AS {self.name}" if self.name else inner

    # arithmetic
    def __add__(self, other: Any) -> Expr:
        return Expr("add", self, as_expr(other))

    def __radd__(self, other: Any) -> Expr:
        return Expr("add", as_expr(other), self)

    def __sub__(self, other: Any) -> Expr:
        return Expr("sub", self, as_expr(other))

    def __rsub__(self, other: Any) -> Expr:
        return Expr("sub", as_expr(other), self)

    def __mul__(self, other: Any) -> Expr:
        return Expr("mul", self, as_expr(other))

    def __rmul__(self, other: Any) -> Expr:
        return Expr("mul", as_expr(other), self)

    def __truediv__(self, other: Any) -> Expr:
        """True division; by zero it gives null."""
        return Expr("div", self, as_expr(other))

    def __rtruediv__(self, other: Any) -> Expr:
        return Expr("div", as_expr(other), self)

    def __neg__(self) -> Expr:
        return Expr("neg", self)

    def __mod__(self, other: Any) -> Expr:
        return Expr("mod", self, as_expr(other))

    # comparison and logic
    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return Expr("eq", self, as_expr(other))

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return Expr("ne", self, as_expr(other))

    def __lt__(self, other: Any) -> Expr:
        return Expr("lt", self, as_expr(other))

    def __le__(self, other: Any) -> Expr:
        return Expr("le", self, as_expr(other))

    def __gt__(self, other: Any) -> Expr:
        return Expr("gt", self, as_expr(other))

    def __ge__(self, other: Any) -> Expr:
        return Expr("ge", self, as_expr(other))

    def __and__(self, other: Any) -> Expr:
        return Expr("and", self, as_expr(other))

    def __or__(self, other: Any) -> Expr:
        return Expr("or", self, as_expr(other))

    def __invert__(self) -> Expr:
        return Expr("not", self)

    def isin(self, values: Iterable[Any]) -> Expr:
        return Expr("isin", self, tuple(values))

    def between(self, low: Any, high: Any) -> Expr:
        return (self >= low) & (self <= high)

    def is_null(self) -> Expr:
        return Expr("is_null", self)

    # strings, dates and numbers
    def startswith(self, prefix: str) -> Expr:
        return Expr("startswith", self, prefix)

    def contains(self, part: str) -> Expr:
        return Expr("contains", self, part)

    def substring(self, start: int, length: int) -> Expr:
        return Expr("substring", self, start, length)

    def year(self) -> Expr:
        """The year of a date or timestamp, or of an integer written YYYYMMDD."""
        return Expr("year", self)

    def round(self, digits: int = 0) -> Expr:
        return Expr("round", self, digits)

    def cast(self, kind: str) -> Expr:
        return Expr("cast", self, kind)

    def fill_null(self, value: Any) -> Expr:
        return Expr("coalesce", self, as_expr(value))

    # aggregates
    def sum(self) -> Expr:
        return Expr("sum", self)

    def min(self) -> Expr:
        return Expr("min", self)

    def max(self) -> Expr:
        return Expr("max", self)

    def mean(self) -> Expr:
        return Expr("mean", self)

    def count(self) -> Expr:
        """The number of rows, nulls included."""
        return Expr("count", self)

    def count_distinct(self) -> Expr:
        return Expr("count_distinct", self)

    def approx_count_distinct(self) -> Expr:
        return Expr("approx_count_distinct", self)

    def std(self) -> Expr:
        return Expr("std", self)

    def var(self) -> Expr:
        return Expr("var", self)

    def median(self) -> Expr:
        return Expr("median", self)

    # windows
    def over(self, *partition_by: str | Expr, order_by: Any = None, descending: bool = False) -> Expr:
        """Evaluate over each partition. ``order_by`` matters to row_number, lag, lead and cum_sum only."""
        order = (order_by,) if isinstance(order_by, (str, Expr)) else tuple(order_by or ())
        return Expr("window", self, tuple(partition_by), order, descending)

    def rank(self) -> Expr:
        """Rank by this column, ascending, with gaps after ties."""
        return Expr("rank", self)

    def dense_rank(self) -> Expr:
        return Expr("dense_rank", self)

    def lag(self, n: int = 1, default: Any = None) -> Expr:
        return Expr("lag", self, n, default)

    def lead(self, n: int = 1, default: Any = None) -> Expr:
        return Expr("lead", self, n, default)

    def cum_sum(self) -> Expr:
        return Expr("cum_sum", self)

    def children(self) -> list[Expr]:
        out: list[Expr] = []
        for a in self.args:
            out += [a] if isinstance(a, Expr) else [x for x in a if isinstance(x, Expr)] if isinstance(a, tuple) else []
        return out

    def walk(self) -> Iterable[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()


def col(name: str) -> Expr:
    return Expr("col", name)


def lit(value: Any) -> Expr:
    return Expr("lit", value)


def when(condition: Expr, then: Any, otherwise: Any = 0) -> Expr:
    """``then`` where the condition holds, ``otherwise`` where it doesn't or is null."""
    return Expr("when", condition, as_expr(then), as_expr(otherwise))


def row_number() -> Expr:
    """1, 2, 3, ... in the order of ``over(order_by=...)``; without one the order is unspecified."""
    return Expr("row_number")


def call(function: str, *args: Any) -> Expr:
    """Any Spark SQL function by name."""
    return Expr("call", function, *[as_expr(a) for a in args])
