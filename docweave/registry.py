"""Name -> query and SQL of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.plans import caches, cutting, indexes, logs, search, structures, texts

ALL = {**texts.QUERIES, **search.QUERIES, **logs.QUERIES, **structures.QUERIES, **cutting.QUERIES, **indexes.QUERIES, **caches.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, (_, sql) in ALL.items() if sql}


def flagship(spark: SparkSession, data_dir: str) -> DataFrame:
    """Hybrid retrieval over the chunks."""
    return search.hybrid_chunks(spark, data_dir)
