"""All queries of this library, by name, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..plans.domain import duckdb_query, spark_query
from . import analytics, answers, graph, ingest, intake, relational, rollups, screens, search, sheets, text, vector

TEXTS: dict[str, str] = relational.QUERIES | analytics.QUERIES | graph.QUERIES | text.QUERIES


def _hinted(name: str) -> str:
    """The query's text, with a hint where a join has to be by sorting; the oracle's text has none."""
    table = relational.SORTED_JOINS.get(name)
    return TEXTS[name].replace("SELECT ", f"SELECT /*+ MERGE({table}) */ ", 1) if table else TEXTS[name]


def _run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_query(spark, sf_dir, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, _hinted(name)) for name in TEXTS} | graph.FRAMES | vector.QUERIES | answers.QUERIES | sheets.QUERIES | ingest.QUERIES | search.QUERIES | rollups.QUERIES | intake.QUERIES | screens.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_query(sql) for name, sql in TEXTS.items()} | vector.SQL | answers.SQL | sheets.SQL | ingest.SQL | search.SQL | rollups.SQL | intake.SQL | screens.SQL
