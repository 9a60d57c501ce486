"""All queries of the plan modules."""

from __future__ import annotations

from . import images, names, ordered, texts, tools, trees, updates  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
