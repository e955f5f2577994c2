"""All registered queries and their oracle statements."""

from __future__ import annotations

from wtel import schemas
from wtel.fixtures import (
    oracle_plans,
    oracle_polls,
    oracle_semantics,
    queries_plans,
    queries_polls,
    queries_semantics,
    queries_streams,
)
from wtel.fixtures.views import duck

QUERIES = {
    **queries_polls.QUERIES,
    **queries_semantics.QUERIES,
    **queries_plans.QUERIES,
    **queries_streams.QUERIES,
}
STATEMENTS = {
    **oracle_polls.statements(),
    **oracle_semantics.statements(),
    **oracle_plans.statements(),
}
STATEMENTS |= {stream: STATEMENTS[batch] for stream, batch in queries_streams.TWINS.items()}
_TABLES = ", ".join(f"('{t}')" for t in schemas.TABLES)
STATEMENTS["snk1_ensure_tables"] = duck(
    f"""SELECT t.table_name, CASE WHEN t.table_name = 'queries'
          THEN (SELECT count(*) FROM $query_log) ELSE 0 END AS n
        FROM (VALUES {_TABLES}) t(table_name)"""
)
STATEMENTS["snk2_append_rows"] = duck(
    "SELECT query_id AS \"queryId\", query_string AS \"queryString\" FROM $query_log"
)
