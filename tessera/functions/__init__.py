"""Expressions: an immutable tree that is resolved to Spark columns."""

from .expr import Expr, call, col, lit, row_number, when

__all__ = ["Expr", "call", "col", "lit", "row_number", "when"]
