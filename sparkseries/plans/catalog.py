"""All registered queries of the library."""

from __future__ import annotations

from . import evaluation_queries, model_queries, series_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
