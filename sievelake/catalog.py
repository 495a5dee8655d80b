"""All queries of the library by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import change_queries as _changes  # noqa: F401
from .plans import flow_queries as _flows  # noqa: F401
from .plans import review_queries as _more  # noqa: F401  registers its queries
from .plans import stream_queries as _streams  # noqa: F401
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "rule_scan_severity_rollup"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
