"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from . import queries_analysis, queries_files, queries_tables  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
