"""All queries of the engine's own operators and their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
#: Modules that register queries, by theme.
MODULES = ("q_intervals", "q_scoring", "q_joins", "q_aggregates", "q_windows", "q_functions", "q_selection", "q_similarity", "q_speech", "q_evaluation", "q_sources")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) -> DataFrame under a name, with DuckDB SQL where SQL can express it."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries named {name}")
        _queries[name] = f
        if oracle is not None:
            _oracles[name] = oracle
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"sceneql.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every video: scored, smoothed, expanded, merged and chosen under a time budget."""
    return queries()["api_summarize"](spark, sf_dir)
