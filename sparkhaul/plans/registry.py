"""Registers queries: a name, a Spark query and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, Callable]:
    queries: dict = {}

    def query(name: str, sql: str | None):
        def keep(f):
            queries[name] = (f, sql)
            return f

        return keep

    return queries, query
