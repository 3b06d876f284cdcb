"""All core queries and their SQL, collected from the modules of this package."""

from __future__ import annotations

from flowloom.plans import flow_queries, flow_sql, problems

MODULES = (problems, flow_queries, flow_sql)
QUERIES = {k: v for m in MODULES for k, v in getattr(m, "QUERIES", {}).items()}
SQL = {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
