"""Registry of the core queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import orphans
from tessera.plans import eval_queries, lift_queries, lift_sql

MODULES = [orphans, lift_queries, eval_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return orphans.SQL | lift_sql.SQL | eval_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift_queries.hypothesis_scores(spark, sf_dir)
