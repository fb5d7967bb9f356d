"""The registered queries: 22 decision-support queries and one for each operator."""

from __future__ import annotations

from . import operators, star

QUERIES = star.QUERIES | operators.QUERIES
ORACLES = star.ORACLES | operators.ORACLES
