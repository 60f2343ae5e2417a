"""All named queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import fixture_queries, general, graph_queries, pipeline_queries, report_queries, search_queries, text_queries

MODULES = [general, graph_queries, report_queries, text_queries, search_queries, pipeline_queries, fixture_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
