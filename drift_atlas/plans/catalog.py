"""Registry of the engine's queries and of their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from drift_atlas.plans import distance_queries, message_queries, note_queries, relation_queries, relational_queries, render_queries, study_queries

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = [note_queries, message_queries, distance_queries, render_queries, relational_queries, relation_queries, study_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of embedding sets ranked by Fréchet distance."""
    return queries()["m07_rank_by_distance"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
