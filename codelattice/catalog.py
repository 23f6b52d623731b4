"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelattice.queries import codes, decoding, encoding, layouts, logs

AREAS = (codes, encoding, layouts, decoding, logs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {name: f for area in AREAS for name, f in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the name of the query."""
    return {name: sql for area in AREAS for name, sql in area.ORACLE.items()}
