"""Relational operators: the lazy frame and its grouping."""

from .frame import GPUFrame, LazyFrame, LazyGroupBy

__all__ = ["GPUFrame", "LazyFrame", "LazyGroupBy"]
