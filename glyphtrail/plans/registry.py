"""Registered queries: name -> (function of spark and folder, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import lexicon as L

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (f, sql)
        return f

    return add


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], name: str, columns: str) -> str:
    """A CTE of literal rows."""
    cell = lambda v: quoted(v) if isinstance(v, str) else "NULL" if v is None else repr(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


LEX = values(L.rows(L.DEMO), "lex", "category, phrase, ord")


def any_of(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in phrases) + ")"
