"""The table of named queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dataweft.sources.inputs import INPUT_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("io", "cleaning", "relational", "profiling", "windows", "versioned", "graphs", "recommender",
           "classifying", "chats", "experimenting")


def query(name: str, sql: str | None = None, inputs: tuple[str, ...] = (), ctes: dict[str, str] | None = None):
    """Register a query; its SQL sees the named inputs and extra ``ctes`` as common table expressions."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            parts = {**{i: INPUT_SQL[i] for i in inputs}, **(ctes or {})}
            head = ",\n".join(f"{n} AS ({body})" for n, body in parts.items())
            ORACLES[name] = (f"WITH RECURSIVE {head}\n{sql}" if head else sql).strip()
        return fn
    return register


def half_even(x: str) -> str:
    """SQL for rounding a double to an integer with ties to even, as ``rint`` does."""
    return f"(CASE WHEN abs(({x}) - trunc({x})) = 0.5 THEN 2 * round(({x}) / 2) ELSE round({x}) END)"


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"dataweft.plans.{module}")
    return QUERIES, ORACLES
