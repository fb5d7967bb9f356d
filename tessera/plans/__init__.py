"""SQL, explanations and plan utilities."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from ..operators import LazyFrame
from ..session import get_spark

_lock = threading.Lock()


def sql(query: str, **tables) -> LazyFrame:
    """Run Spark SQL over the given tables (frames, DataFrames or Arrow tables), bound by name.

    The names are bound for the analysis only: views of the session with the
    same names are back in place when the call returns.
    """
    spark = get_spark()
    with _lock:
        before = {}
        for name in tables:
            if spark.catalog._jcatalog.tableExists(name):
                before[name] = spark.table(name)
        try:
            for name, t in tables.items():
                LazyFrame(t).df.createOrReplaceTempView(name)
            return LazyFrame(spark.sql(query))
        finally:
            for name in tables:
                spark.catalog.dropTempView(name)
                if name in before and not spark.catalog._jcatalog.tableExists(name):
                    before[name].createOrReplaceTempView(name)


@dataclass(frozen=True)
class PlanError:
    path: str
    message: str


def validate_plan(frame: LazyFrame) -> list[PlanError]:
    """Problems of a frame's plan; empty if it can be planned. Arguments were checked when the frame was built."""
    try:
        frame.df._jdf.queryExecution().executedPlan()
    except Exception as e:  # what Spark says about a plan it can't make is the result here
        return [PlanError("plan", str(e).splitlines()[0])]
    return []


def validate_plan_or_raise(frame: LazyFrame) -> None:
    if found := validate_plan(frame):
        raise ValueError("invalid plan: " + "; ".join(f"{e.path}: {e.message}" for e in found))


@dataclass(frozen=True)
class OptimizationResult:
    """Catalyst's optimised plan as text, and the operators whose number it changed."""

    plan: str
    trace: list[str]


def optimize_plan(frame: LazyFrame) -> OptimizationResult:
    run = frame.df._jdf.queryExecution()
    count = lambda text: {w: sum(line.lstrip(" +-:").startswith(w) for line in text.splitlines()) for w in ("Filter", "Project", "Join", "Aggregate", "Sort", "GlobalLimit", "Window")}
    before, plan = count(run.analyzed().toString()), run.optimizedPlan().toString()
    after = count(plan)
    return OptimizationResult(plan, [f"{k}: {before[k]} -> {after[k]}" for k in before if before[k] != after[k]] or ["no_op"])


def signature(frame: LazyFrame) -> int:
    """Equal for plans that compute the same, up to cosmetic differences."""
    return frame.df.semanticHash()


def explain(frame: LazyFrame, optimized: bool = True, validate: bool = False, include_runtime: bool = False) -> str:
    run = frame.df._jdf.queryExecution()
    lines = ["OptimizedPlan", run.optimizedPlan().toString(), "PhysicalPlan", run.executedPlan().toString()] if optimized else ["LogicalPlan", run.analyzed().toString()]
    if optimized:
        lines += ["Changes", *optimize_plan(frame).trace]
    if validate:
        lines += ["Validation", "ok" if not (e := validate_plan(frame)) else f"errors={len(e)}"]
    if include_runtime:
        ran = frame.last_compile_provenance
        lines += ["LastRun", *([f"{k}={v}" for k, v in ran.items()] or ["none (run compute() first)"])]
    return "\n".join(lines)


__all__ = ["OptimizationResult", "PlanError", "explain", "optimize_plan", "signature", "sql", "validate_plan", "validate_plan_or_raise"]
