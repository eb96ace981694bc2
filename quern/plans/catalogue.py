"""All queries over the library's own operators, and SQL that gives the same rows."""

from __future__ import annotations

from quern.plans import language, search, series, tabular, values  # noqa: F401  they register their queries
from quern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
