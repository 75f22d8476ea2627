"""The registered queries of the engine itself, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.plans import queries as q
from cairnspark.plans import report_queries, report_sql, sql

_WITHOUT_SQL = (q.duplicates_parts, q.chunk_plan_documents, q.visible_text_pages, q.usage_caps_events, q.headings_documents)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(q, name) for name in sql.ORACLE_SQL} | report_queries.QUERIES | {f.__name__: f for f in _WITHOUT_SQL}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL | report_sql.SQL


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    """Documents scanned for indicators, merged into a graph, and its nodes counted by type."""
    node, _ = q._contributions(spark, sf_dir)
    return node.select("node_id", "type").distinct().groupBy("type").agg(F.count("*").alias("nodes"))
