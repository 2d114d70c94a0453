"""Where queries are entered with the SQL that gives the same rows."""

from __future__ import annotations

from cardloom.sources.tables import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Enters the function under its own name. sql: DuckDB SQL over the base tables and the views."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return enter
