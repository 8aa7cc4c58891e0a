"""All queries of the core by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lodeshift.plans.registry import QUERIES, SQL

for _name in ("scoring", "statistics", "sources", "text", "structuring", "requirements", "names", "career", "reports", "vectors", "problems"):
    import_module(f"lodeshift.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_shortlist"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
