"""Queries over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

from trellis.queries import more, operators, patterns

QUERIES = dict(patterns.QUERIES) | operators.QUERIES | more.QUERIES
ORACLE_SQL = dict(patterns.ORACLE_SQL) | operators.ORACLE_SQL | more.ORACLE_SQL
