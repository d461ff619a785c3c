"""All queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import reference_queries, relational, surveyed

QUERIES = {**reference_queries.QUERIES, **relational.QUERIES, **surveyed.QUERIES}
ORACLE_SQL = {**reference_queries.oracle(), **relational.ORACLE_SQL, **surveyed.oracle()}
