"""A Spark-native analytics engine: lazy frames, SQL and a decision-support workload."""

from .functions import Expr, call, col, lit, row_number, when
from .operators import GPUFrame, LazyFrame, LazyGroupBy
from .plans import OptimizationResult, optimize_plan, signature, sql, validate_plan, validate_plan_or_raise
from .plans.nodes import Aggregate, Distinct, Filter, Join, Limit, Project, Scan, Sort, Tail
from .session import clear_cache, get_spark, warmup
from .sources import from_arrow, from_pandas, from_polars, load_tables, read_csv, read_parquet, scan

__all__ = [
    "Aggregate", "Distinct", "Filter", "Join", "Limit", "Project", "Sort", "Tail",
    "Expr", "GPUFrame", "LazyFrame", "LazyGroupBy", "OptimizationResult", "Scan", "call", "clear_cache", "col", "from_arrow", "from_pandas",
    "from_polars", "get_spark", "lit", "load_tables", "optimize_plan", "read_csv", "read_parquet", "row_number", "scan", "signature", "sql",
    "validate_plan", "validate_plan_or_raise", "warmup", "when",
]
