"""Named queries over the test tables, and the SQL that DuckDB answers them with."""

from __future__ import annotations

from . import table_queries, terrain_queries

QUERIES = terrain_queries.QUERIES | table_queries.QUERIES
ORACLE_SQL = terrain_queries.ORACLE_SQL | table_queries.ORACLE_SQL
FLAGSHIP = terrain_queries.labelled_dataset
