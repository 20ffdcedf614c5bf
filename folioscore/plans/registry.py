"""All registered queries over the standard tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import documents, evaluation, structure
from .tables import FOUND, Query

QUERIES: dict[str, Query] = {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s() if callable(s) else s for k, (_, s) in FOUND.items() if s is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.char_similarity_by_language(spark, sf_dir)


__all__ = ["QUERIES", "documents", "flagship", "oracle_sql", "structure"]
