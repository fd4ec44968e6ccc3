"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("q_mixing", "q_byte_bpe", "q_token_counts", "q_vectors", "q_toxicity", "q_parity_join", "q_substrings", "q_attention_lm", "q_html_text", "q_warc", "q_maxscore")


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"dataweft.llm.{module}")
    return QUERIES, ORACLES
