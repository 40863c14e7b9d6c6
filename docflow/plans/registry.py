"""Registry of named queries: a Spark builder and (optionally) an equivalent DuckDB SQL.

Builders take (spark, sf_dir) and return a DataFrame over the given tables. SQL runs
on DuckDB views of the same parquet files and is the correctness oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: str


QUERIES: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, ops)
        return fn
    return deco


PLAN_MODULES = ("q_retrieval", "q_text", "q_metrics", "q_guardrails", "q_transcripts", "q_loops",
                "q_traces", "q_index", "q_models", "q_streams", "q_sources")


def load_all() -> dict[str, Query]:
    """Import the plan modules (which fills the registry) and return it."""
    import importlib

    for m in PLAN_MODULES:
        try:
            importlib.import_module(f"docflow.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"docflow.plans.{m}":
                raise
    return QUERIES
