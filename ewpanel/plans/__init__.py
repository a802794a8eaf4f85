"""Registered queries and their SQL."""

from ewpanel.plans import candidates, evaluation, fits, graphs, modelling, more, panels, sweeping, wide  # noqa: F401
from ewpanel.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
