"""Plan nodes as functions: each returns the frame that computes it.

For those who write plans node by node instead of chaining methods, e.g.
``LazyFrame(Limit(Sort(Scan(t), [col("a")], [True]), 5))``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from ..functions import Expr
from ..operators import LazyFrame


def Scan(table: Any) -> LazyFrame:  # noqa: N802
    return LazyFrame(table)


def Filter(input: Any, predicate: Expr) -> LazyFrame:  # noqa: A002, N802
    return LazyFrame(input).filter(predicate)


def Project(input: Any, exprs: Sequence[Any]) -> LazyFrame:  # noqa: A002, N802
    return LazyFrame(input).select(*exprs)


def Aggregate(input: Any, group_by: Sequence[Any], aggs: Sequence[Expr]) -> LazyFrame:  # noqa: A002, N802
    return LazyFrame(input).groupby(*group_by).agg(*aggs)


def Sort(input: Any, by: Sequence[Any], descending: bool | Sequence[bool] = False) -> LazyFrame:  # noqa: A002, N802
    return LazyFrame(input).sort(*by, descending=descending)


def Limit(input: Any, n: int) -> LazyFrame:  # noqa: A002, N802
    return LazyFrame(input).limit(n)


def Tail(input: LazyFrame, n: int) -> LazyFrame:  # noqa: A002, N802
    return input.tail(n)


def Distinct(input: Any, subset: Sequence[str] | None = None) -> LazyFrame:  # noqa: A002, N802
    return LazyFrame(input).distinct(*(subset or ()))


def Join(left: Any, right: Any, left_on: Sequence[str], right_on: Sequence[str], how: str = "inner") -> LazyFrame:  # noqa: N802
    return LazyFrame(left).join(LazyFrame(right), left_on=left_on, right_on=right_on, how=how)
