"""All registered queries of the reference operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from delvegraph.queries import graph, history, overlays, registry, scalars, serving, text  # noqa: F401  they register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_query_callers(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
