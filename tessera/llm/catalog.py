"""Registry of the training-data queries; nothing outside this subpackage imports it but the driver's entry."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["sentences", "format_dups", "splitting", "clusters", "near_dups", "answers", "packing", "mixing", "abuse"]


def _modules() -> list:
    return [importlib.import_module(f"tessera.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
