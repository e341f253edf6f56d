"""All queries of the graph engine by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import build_queries, flow_queries, index_queries, search_queries, temporal_queries
from .storage import leaves_one_table

MODULES = [temporal_queries, search_queries, flow_queries, build_queries, index_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each leaves its result in the shared folder at most; what it wrote on the way is deleted."""
    return {name: leaves_one_table(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
