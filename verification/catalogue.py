"""All registered queries and their SQL."""

from __future__ import annotations

from verification import analyses, daily, hourly, loading, places

PARTS = [daily, analyses, hourly, places, loading]


def queries() -> dict:
    return {name: fn for part in PARTS for name, fn in part.Q.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
