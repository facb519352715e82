"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import archive_queries, archive_sql
from textloom.sources import archive


def spark_text(name: str) -> str:
    q = archive_sql.QUERIES[name]
    return (q if isinstance(q, str) else q[0]).replace("WITH_CTE", "WITH").replace("'_'{g}", "'_'").replace(" // ", " div ")


def duckdb_text(name: str) -> str:
    q = archive_sql.QUERIES[name]
    text = (q if isinstance(q, str) else q[1]).replace("'_'{g}", "'_', 'g'").strip()
    for word in ("WITH_CTE", "WITH"):  # further common table expressions behind the model's
        if text.startswith(word + " "):
            return f"{archive.DUCKDB}, {text[len(word) + 1:]}"
    return archive.DUCKDB + text


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return archive.query(spark, sf_dir, spark_text(name))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in archive_sql.QUERIES} | archive_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_text(name) for name in archive_sql.QUERIES} | archive_queries.ORACLE_SQL
