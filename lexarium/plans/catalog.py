"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from ..streaming import queries as streaming_queries  # noqa: F401
from . import compare_queries, search_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
