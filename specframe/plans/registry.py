"""Registry that keeps each query next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in SQL_VIEWS[name][0]:
            visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """Prefix ``body`` (a SELECT, or further CTEs followed by one) with the named views."""
    body = body.strip()
    # Letter counts are taken once, however many views read them.
    kept = {"fx_letter_segments"}
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in kept else ''}({SQL_VIEWS[name][1].strip()})" for name in _needed(views))
    word = "WITH RECURSIVE" if recursive else "WITH"
    if body.upper().startswith("SELECT"):
        return f"{word} {ctes}\n{body}" if ctes else body
    return f"{word} {ctes + ',' if ctes else ''}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register a query; ``sql`` may be left out where SQL cannot express it."""

    def wrap(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, recursive=recursive)
        return function

    return wrap
