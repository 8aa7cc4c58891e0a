"""The llm queries by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeshift.llm import plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(plans, name) for name in ("p2_found", "p2_organisations", "p3_found", "p3_redacted", "p4_found", "p4_paragraphs", "p5_found", "p7_ids", "p8_mix", "p8_shares", "p9_found")}


def oracle_sql() -> dict[str, str]:
    return {}
