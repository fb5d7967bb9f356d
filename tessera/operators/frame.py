"""The lazy frame: a thin, immutable layer over a Spark DataFrame.

Every method adds to the DataFrame's plan; Catalyst prunes, pushes down, orders
joins and picks physical operators, and AQE re-plans at run time. Arguments are
checked when a method is called, so mistakes surface before anything runs.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, col
from ..session import get_spark
from .resolve import ORDER, named, needs_order, resolve
from .spread import lift

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def _exprs(items: Sequence[Any], what: str) -> list[Expr]:
    out = [col(x) if isinstance(x, str) else x for x in items]
    if any(not isinstance(x, Expr) for x in out):
        raise ValueError(f"{what} must be column names or expressions")
    return out


def _count(n: int, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{what} takes a whole number of at least 0, not {n!r}")
    return n


class LazyFrame:
    """A query over a Spark DataFrame; ``frame.df`` is that DataFrame."""

    def __init__(self, source: Any, _sort: tuple[list[Column], list[Column]] | None = None):
        if isinstance(source, LazyFrame):
            source = source.df
        if isinstance(source, pa.Table):
            source = get_spark().createDataFrame(source)
        if not isinstance(source, DataFrame):
            raise ValueError(f"a frame needs a DataFrame or an Arrow table, not {type(source).__name__}")
        self.df = source
        self._sort = _sort
        self._ran: dict[str, Any] = {}

    # projection and filters
    def _project(self, exprs: list[Expr], names: list[str]) -> LazyFrame:
        df = self.df
        if any(map(needs_order, exprs)):
            df = df.withColumn(ORDER, F.monotonically_increasing_id())
        lifted = []
        for e in exprs:
            e, df = lift(e, df)
            lifted.append(e)
        exprs = lifted
        return LazyFrame(df.select(*[resolve(e, df).alias(n) for e, n in zip(exprs, names, strict=True)]))

    def select(self, *exprs: Any) -> LazyFrame:
        """Columns by name or expression; unnamed expressions are called ``col_<i>``."""
        parsed = _exprs(exprs, "select()")
        if not parsed:
            raise ValueError("select() needs at least one column")
        return self._project(parsed, [e.name or (e.args[0] if e.op == "col" else f"col_{i}") for i, e in enumerate(parsed)])

    def with_columns(self, *exprs: Any) -> LazyFrame:
        """Add columns after the others; a column of the same name is replaced and moves to the end."""
        parsed = _exprs(exprs, "with_columns()")
        names = [e.name or (e.args[0] if e.op == "col" else f"col_{i}") for i, e in enumerate(parsed)]
        kept = [c for c in self.df.columns if c not in names]
        return self._project([col(c) for c in kept] + parsed, kept + names)

    def filter(self, predicate: Expr) -> LazyFrame:
        """Rows for which the predicate is true; null counts as false."""
        if not isinstance(predicate, Expr):
            raise ValueError("filter() takes an expression")
        return LazyFrame(self.df.where(resolve(predicate, self.df)), self._sort)

    # aggregation
    def groupby(self, *by: Any) -> LazyGroupBy:
        return LazyGroupBy(self, _exprs(by, "groupby()"))

    def agg(self, *aggs: Expr) -> LazyFrame:
        return self.groupby().agg(*aggs)

    # joins
    def join(self, other: LazyFrame, *, on: Any = None, left_on: Any = None, right_on: Any = None, how: str = "inner", suffix: str | None = None) -> LazyFrame:
        """Equi-join: all columns of the left side, then the right side's columns except its keys.

        ``how``: inner, left, right, full, semi, anti or cross (without keys).
        Null keys match nothing. A right column whose name the left side has too
        raises ``ValueError`` unless ``suffix`` is given.
        """
        if how not in JOINS:
            raise ValueError(f"unsupported join type {how!r}; use one of {', '.join(JOINS)}")
        if how == "cross":
            if on is not None or left_on is not None or right_on is not None:
                raise ValueError("a cross join takes no keys")
            lk: list[str] = []
            rk: list[str] = []
        elif on is not None:
            if left_on is not None or right_on is not None:
                raise ValueError("give either on or left_on and right_on, not both")
            lk = rk = [on] if isinstance(on, str) else list(on)
        elif left_on is None or right_on is None:
            raise ValueError("give either on or both left_on and right_on")
        else:
            lk = [left_on] if isinstance(left_on, str) else list(left_on)
            rk = [right_on] if isinstance(right_on, str) else list(right_on)
        if how != "cross" and (not lk or len(lk) != len(rk)):
            raise ValueError("the key lists must have the same length, one at least")
        for keys, frame, side in ((lk, self, "left"), (rk, other, "right")):
            if missing := [k for k in keys if k not in frame.df.columns]:
                raise ValueError(f"the {side} side has no column {', '.join(missing)}")
        hidden = {c: f"__right_{i}" for i, c in enumerate(other.df.columns)}
        right = other.df.select(*[named(c).alias(h) for c, h in hidden.items()])
        cond = None
        for a, b in zip(lk, rk, strict=True):
            one = named(a) == named(hidden[b])
            cond = one if cond is None else cond & one
        joined = self.df.crossJoin(right) if how == "cross" else self.df.join(right, cond, JOINS[how])
        if how in ("semi", "anti"):
            return LazyFrame(joined)
        back = dict(zip(lk, rk, strict=True)) if how in ("right", "full", "outer") else {}
        out = [F.coalesce(named(c), named(hidden[back[c]])).alias(c) if c in back else named(c) for c in self.df.columns]
        for c in other.df.columns:
            if c in rk:
                continue
            name = c
            if c in self.df.columns:
                if suffix is None:
                    raise ValueError(f"both sides have a column {c}; give a suffix")
                name = c + suffix
            out.append(named(hidden[c]).alias(name))
        return LazyFrame(joined.select(*out))

    # order and limits
    def sort(self, *by: Any, descending: bool | Sequence[bool] = False) -> LazyFrame:
        """Sort by columns or expressions; nulls come last either way."""
        keys = _exprs(by, "sort()")
        if not keys:
            raise ValueError("sort() needs at least one key")
        flags = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        if len(flags) != len(keys):
            raise ValueError("descending must have one flag for each key")
        columns = [resolve(k, self.df) for k in keys]
        order = [c.desc_nulls_last() if d else c.asc_nulls_last() for c, d in zip(columns, flags, strict=True)]
        back = [c.asc_nulls_first() if d else c.desc_nulls_first() for c, d in zip(columns, flags, strict=True)]
        return LazyFrame(self.df.orderBy(*order), (order, back))

    def limit(self, n: int) -> LazyFrame:
        return LazyFrame(self.df.limit(_count(n, "limit()")))

    def head(self, n: int = 5) -> LazyFrame:
        return self.limit(n)

    def tail(self, n: int = 5) -> LazyFrame:
        """The last n rows. After a sort this is a top-n of the reversed order, sorted back.

        Of an unsorted frame it is a top-n by position in the input's partitions; nothing runs until the result is asked for.
        """
        _count(n, "tail()")
        if self._sort:
            order, back = self._sort
            return LazyFrame(self.df.orderBy(*back).limit(n).orderBy(*order), self._sort)
        placed = self.df.withColumn(ORDER, F.monotonically_increasing_id())
        return LazyFrame(placed.orderBy(F.desc(ORDER)).limit(n).orderBy(ORDER).drop(ORDER))

    def distinct(self, *subset: str) -> LazyFrame:
        """Distinct rows; with a subset, the distinct combinations of these columns only."""
        if len(set(subset)) != len(subset):
            raise ValueError("distinct() names a column twice")
        df = self.df.select(*map(named, subset)) if subset else self.df
        return LazyFrame(df.distinct())

    # set operations
    def union(self, other: LazyFrame, distinct: bool = False) -> LazyFrame:
        both = self.df.unionByName(other.df)
        return LazyFrame(both.distinct() if distinct else both)

    def intersect(self, other: LazyFrame) -> LazyFrame:
        return LazyFrame(self.df.intersect(other.df))

    def except_(self, other: LazyFrame) -> LazyFrame:
        return LazyFrame(self.df.subtract(other.df))

    # summaries
    def describe(self, device: str = "auto", accuracy: int | None = None) -> LazyFrame:
        """count, mean, std, min, quartiles and max of the numeric columns, nulls and NaN left out.

        One aggregation. Quartiles are exact by default, which keeps each
        column's distinct values in memory; ``accuracy`` switches to Spark's
        bounded-memory approximation.
        """
        numeric = [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.NumericType)]
        if not numeric:
            raise ValueError("describe() found no numeric column")
        stats: dict[str, list[Column]] = {}
        for c in numeric:
            v = F.nanvl(named(c).cast("double"), F.lit(None).cast("double"))
            quartiles = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy) if accuracy else F.percentile(v, [0.25, 0.5, 0.75])
            found = [F.count(v).cast("double"), F.avg(v), F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0), F.min(v), *[F.element_at(quartiles, i) for i in (1, 2, 3)], F.max(v)]
            for label, x in zip(("count", "mean", "std", "min", "25%", "50%", "75%", "max"), found, strict=True):
                stats.setdefault(label, []).append(x.alias(c))
        rows = F.array(*[F.struct(F.lit(label).alias("statistic"), *found) for label, found in stats.items()])
        return LazyFrame(self.df.agg(rows.alias("r")).select(F.inline("r")))

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def explain(self, optimized: bool = True, validate: bool = False, include_runtime: bool = False) -> str:
        """Spark's logical and physical plans as text."""
        from ..plans import explain

        return explain(self, optimized, validate, include_runtime)

    # execution
    def compute(self, device: str = "auto", verbose: bool = False, optimize: bool = True, validate: bool = True) -> pa.Table:
        """Run the query and return an Arrow table. ``device``, ``optimize`` and ``validate`` are accepted for compatibility."""
        if device not in ("auto", "cpu", "gpu"):
            raise ValueError(f"unknown device {device!r}")
        began = time.perf_counter()
        out = self.df.toArrow()
        self._ran = {"device": "spark", "rows": out.num_rows, "execute_ms": round(1000 * (time.perf_counter() - began), 3), "path": "catalyst"}
        if verbose:
            print(self._ran)
        return out

    @property
    def last_compile_provenance(self) -> dict:
        return dict(self._ran)

    def to_arrow(self) -> pa.Table:
        return self.compute()

    def to_pandas(self):
        return self.compute().to_pandas()

    def to_polars(self):
        import polars

        return polars.from_arrow(self.compute())

    def to_gpu(self, device: str = "auto") -> GPUFrame:
        """Keep the frame's rows in the executors' memory and disk across queries."""
        return GPUFrame(self.df.persist())

    def write_parquet(self, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
        self.df.write.mode(mode).partitionBy(*partition_by).parquet(path)

    def write_csv(self, path: str, mode: str = "error") -> None:
        self.df.write.mode(mode).csv(path, header=True)


class GPUFrame(LazyFrame):
    """A frame whose rows stay cached; results of its methods are ordinary frames."""

    def release(self) -> None:
        self.df.unpersist()


class LazyGroupBy:
    """``frame.groupby(...)``: call ``agg`` on it. Without keys there is one group of all rows."""

    def __init__(self, frame: LazyFrame, by: list[Expr]):
        self.frame, self.by = frame, by

    def agg(self, *aggs: Expr) -> LazyFrame:
        parsed = _exprs(aggs, "agg()")
        if not parsed:
            raise ValueError("agg() needs at least one aggregate")
        df = self.frame.df
        keys = [resolve(k, df).alias(k.name or (k.args[0] if k.op == "col" else f"key_{i}")) for i, k in enumerate(self.by)]
        found = [resolve(a, df).alias(a.name or f"agg_{i}") for i, a in enumerate(parsed)]
        return LazyFrame(df.groupBy(*keys).agg(*found) if keys else df.agg(*found))
