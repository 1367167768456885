"""Registration of queries and assembly of their SQL from named common table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """Make ``name`` usable in the SQL of any query registered later."""
    CTES[name] = body.strip()


def with_ctes(body: str) -> str:
    """``body`` preceded by every common table expression it needs, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    head = ",\n".join(f"{name} as ({CTES[name]})" for name in ordered)
    extra = re.match(r"\s*with\s+(recursive\s+)?", body)
    if extra:
        return f"with {extra[1] or ''}{head},\n{body[extra.end():].strip()}"
    return f"with {head}\n{body.strip()}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn

    return register
