"""All queries of the reference's operators: name -> Spark query, and name -> equivalent DuckDB SQL."""

from __future__ import annotations

from . import cascade_queries, evidence_queries, field_queries, place_queries, report_queries, route_queries, search_queries, source_queries, stop_queries, stream_queries

QUERIES: dict = {}
ORACLE: dict = {}
for module in (evidence_queries, stop_queries, search_queries, place_queries, report_queries, field_queries, stream_queries, route_queries, source_queries, cascade_queries):
    for name, (query, sql) in module.QUERIES.items():
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
