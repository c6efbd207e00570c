"""Queries over the test tables, with SQL."""

from . import catalog, further, library, more, search, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
