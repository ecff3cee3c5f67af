"""Every query of the library by name, with the SQL that says what it should return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import elements, evaluation, sections, segments, sessions, vectors, views  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements to coarse chunks, the whole way."""
    return QUERIES["coarse_end_to_end"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
