"""The queries over the given tables and their SQL twins."""

from __future__ import annotations

from . import claims, indexes, ingest, labels, learners, lookups, prices, profiles, reports, rulesets, scalars, silence, streams  # noqa: F401  (they register their queries)
from .tables import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
