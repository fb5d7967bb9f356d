"""Whole-table window functions without putting the table in one task.

They are evaluated inside buckets of the order key and shifted by the totals of
the buckets before: rows, distinct keys or sums. ``lag`` and ``lead`` number the
rows that way and join each row to the one n places away. The buckets come from
approximate quantiles of the key, found by one aggregation of the same query, or
for the input order from the input's partitions; strings are dealt by their
first bytes. Only the quantiles and the bucket totals are broadcast: one row, and
one for each bucket. Equal keys are in one bucket. Keys of other types use one
window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, col
from .resolve import ORDER, named, resolve

SPREAD = ("row_number", "rank", "dense_rank", "cum_sum", "lag", "lead")


def _parts(e: Expr) -> tuple[Expr, tuple, bool] | None:
    """The function, order keys and direction of a whole-table window; None for anything else."""
    if e.op in SPREAD:
        return e, (), False
    if e.op == "window" and e.args[0].op in SPREAD and not e.args[1]:
        return e.args[0], e.args[2], e.args[3]
    return None


def lift(e: Expr, df: DataFrame) -> tuple[Expr, DataFrame]:
    """Replace the whole-table windows inside ``e`` by hidden columns of the returned frame."""
    found = _parts(e)
    if found is not None:
        name = f"__whole_{sum(c.startswith('__whole_') for c in df.columns)}"
        added = _with_whole(df, name, *found)
        return (col(name).alias(e.name) if e.name else col(name), added) if added is not None else (e, df)
    if e.op == "window":
        return e, df
    args = []
    for a in e.args:
        if isinstance(a, Expr):
            a, df = lift(a, df)
        args.append(a)
    return Expr(e.op, *args, name=e.name), df


def _with_whole(df: DataFrame, name: str, inner: Expr, order: tuple, descending: bool) -> DataFrame | None:
    """``df`` with the function's values as a column of that name."""
    if inner.op in ("rank", "dense_rank"):
        order, descending = (inner.args[0],), False
    keys = [named(k) if isinstance(k, str) else resolve(k, df) for k in order] or [named(ORDER)]
    if inner.op in ("lag", "lead"):
        return _neighbour(df, name, inner, order, descending)
    b, n, s, v, q = (f"{name}_{x}" for x in ("b", "n", "s", "v", "q"))
    if order:
        dealt = _bucketed(df, keys[0], descending, b, q)
    else:
        dealt = df.withColumn(b, F.shiftright(named(ORDER), 33).cast("int"))
    if dealt is None:
        return None
    dealt = dealt.withColumn(v, resolve(inner.args[0], df) if inner.op == "cum_sum" else F.lit(None).cast("int"))
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # over the bucket totals
    counted = dealt.groupBy(b, keys[0].alias(q)).agg(F.lit(None).cast("int").alias(v)) if inner.op == "dense_rank" else dealt
    totals = counted.groupBy(b).agg(F.count(F.lit(1)).alias(n), F.sum(v).alias(s))
    starts = totals.select(named(b).alias(f"{b}_"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n), F.sum(s).over(before).alias(s))
    joined = dealt.join(F.broadcast(starts), named(b) == named(f"{b}_"))
    inside = Window.partitionBy(b).orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys])
    if inner.op == "cum_sum":
        own = F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = F.coalesce(named(s) + own, own, named(s))
    else:
        out = named(n) + {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[inner.op]().over(inside)
    return joined.withColumn(name, out).drop(b, f"{b}_", n, s, v)


def _neighbour(df: DataFrame, name: str, inner: Expr, order: tuple, descending: bool) -> DataFrame | None:
    """``lag`` and ``lead``: number the rows, then look up the value n rows away by number."""
    at, far, v, there = (f"{name}_{x}" for x in ("at", "far", "v", "there"))
    placed = _with_whole(df, at, Expr("row_number"), order, descending)
    if placed is None:
        return None
    value, steps, default = resolve(inner.args[0], placed), inner.args[1], inner.args[2]
    shift = steps if inner.op == "lag" else -steps
    others = placed.select((named(at) + shift).alias(far), value.alias(v), F.lit(True).alias(there))
    joined = placed.join(others, named(at) == named(far), "left")
    return joined.withColumn(name, F.when(named(there), named(v)).otherwise(F.lit(default))).drop(at, far, v, there)


def _bucketed(df: DataFrame, key: Column, descending: bool, name: str, quantiles: str) -> DataFrame | None:
    """``df`` with the number of quantiles not above the key, counted in the order's direction; nulls are last."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, T.StringType):  # strings compare by bytes, so their first seven as a number keep the order
        key = F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    elif not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.array_distinct(F.percentile_approx(key, [i / parts for i in range(1, parts)], 1000)).alias(quantiles))
    at = F.coalesce(F.size(F.filter(named(quantiles), lambda c: c <= key)), F.lit(0))
    bucket = F.when(key.isNull(), F.lit(parts)).otherwise(-at if descending else at)
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, bucket).drop(quantiles)  # one row
