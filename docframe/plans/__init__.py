"""Query catalogue: every registered query with its SQL twin."""

from docframe.plans import documents, jobs, models, rows  # noqa: F401  they register their queries
from docframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
