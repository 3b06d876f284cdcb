"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from flowloom.llm import queries, sql

QUERIES = queries.QUERIES
SQL = sql.SQL
