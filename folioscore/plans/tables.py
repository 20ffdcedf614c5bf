"""Reading the standard tables, and the register that queries enter by decoration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | Callable[[], str] | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | Callable[[], str] | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Enters a query with the SQL of the same rows; a callable is asked when a session runs."""

    def enter(f: Query) -> Query:
        FOUND[name or f.__name__] = (f, sql)
        return f

    return enter
