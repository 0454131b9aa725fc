"""All registered queries."""

from __future__ import annotations

from postlake.plans import q_assemble, q_rules, q_runs, q_sources, q_text  # noqa: F401
from postlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
