"""All queries of the library and their SQL."""

from __future__ import annotations

from . import corpus, grounding, notices, retrieval

_MODULES = (corpus, retrieval, notices, grounding)


def _dialect(sql: str) -> str:
    """DuckDB's count_if gives a HUGEINT; a filtered count gives the BIGINT that Spark's does."""
    return sql.replace("count_if(", "count(*) FILTER (WHERE ")


QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: _dialect(s) for m in _MODULES for k, s in m.SQL.items()}
