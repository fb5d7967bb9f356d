"""From expressions to Spark columns."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import AGGREGATES, ORDERED, RANKS, Expr

#: A hidden column with the input order, where a window function asks for one.
ORDER = "__input_order"

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "mod": lambda a, b: a % b,
    "div": F.try_divide, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "and": lambda a, b: a & b,
    "or": lambda a, b: a | b, "coalesce": F.coalesce,
}
GROUPED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": lambda c: F.count(F.lit(1)),
    "count_distinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct, "std": F.stddev_samp,
    "var": F.var_samp, "first": F.first, "last": F.last, "median": F.median, "collect_list": F.collect_list,
}


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: object) -> Column:
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast(T.TimestampNTZType())
    return F.lit(value)


def needs_order(e: Expr) -> bool:
    """Whether the expression has a window function without an order of its own."""
    if e.op == "window":
        inner, _, order, _ = e.args
        return inner.op in ORDERED and not order or any(map(needs_order, inner.children()))
    return e.op in ORDERED or any(map(needs_order, e.children()))


def resolve(e: Expr, df: DataFrame) -> Column:
    """The Spark column of an expression over ``df``, without its alias."""
    op, args = e.op, e.args
    if op == "col":
        return named(args[0])
    if op == "lit":
        return literal(args[0])
    if op in BINARY:
        return BINARY[op](resolve(args[0], df), resolve(args[1], df))
    if op == "call":
        return F.call_function(args[0], *[resolve(a, df) for a in args[1:]])
    if op == "when":
        return F.when(resolve(args[0], df), resolve(args[1], df)).otherwise(resolve(args[2], df))
    if op == "window":
        return windowed(*args, df=df)
    if op in ORDERED or op in RANKS:
        return windowed(e, (), (), False, df=df)
    if op in GROUPED:
        return GROUPED[op](resolve(args[0], df))
    if not args or not isinstance(args[0], Expr):
        raise NotImplementedError(f"unknown operation {op!r}")
    c = resolve(args[0], df)
    if op == "not":
        return ~c
    if op == "neg":
        return -c
    if op == "isin":
        return c.isin([v for v in args[1]]) if args[1] else F.lit(False)
    if op == "is_null":
        return c.isNull()
    if op == "startswith":
        return c.startswith(args[1])
    if op == "contains":
        return c.contains(args[1])
    if op == "substring":
        return F.substring(c, args[1], args[2])
    if op == "round":
        return F.round(c, args[1])
    if op == "cast":
        return c.cast(args[1])
    if op == "year":
        kind = df.select(c.alias("x")).schema["x"].dataType
        whole = isinstance(kind, (T.IntegralType, T.DecimalType))
        return F.call_function("div", c, F.lit(10000)).cast("bigint") if whole else F.year(c).cast("bigint")
    raise NotImplementedError(f"unknown operation {op!r}")


def windowed(inner: Expr, partition: tuple, order: tuple, descending: bool, df: DataFrame) -> Column:
    as_column = lambda k: named(k) if isinstance(k, str) else resolve(k, df)
    whole = Window.partitionBy(*map(as_column, partition))
    if inner.op in AGGREGATES:
        return resolve(inner, df).over(whole)  # an order would make it a running value
    if inner.op in RANKS:
        rank = F.rank() if inner.op == "rank" else F.dense_rank()
        return rank.over(whole.orderBy(resolve(inner.args[0], df).asc_nulls_last())).cast("bigint")
    if inner.op not in ORDERED:
        raise NotImplementedError(f"{inner.op!r} is not a window function")
    keys = [as_column(k).desc_nulls_last() if descending else as_column(k).asc_nulls_last() for k in order]
    ordered = whole.orderBy(*(keys or [named(ORDER).asc()]))
    if inner.op == "row_number":
        return F.row_number().over(ordered).cast("bigint")
    c = resolve(inner.args[0], df)
    if inner.op == "cum_sum":
        return F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.lag if inner.op == "lag" else F.lead)(c, inner.args[1], inner.args[2]).over(ordered)
