"""All registered queries of the library with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warder.plans import audit_queries, check_queries, component_queries, diff_queries, graph_queries, rule_queries, source_queries, stream_queries
from warder.plans.fixtures import Relations, oracle

GROUPS = [audit_queries.QUERIES, rule_queries.QUERIES, component_queries.QUERIES, graph_queries.QUERIES, diff_queries.QUERIES, check_queries.QUERIES, source_queries.QUERIES]


def registered() -> dict:
    return {k: v for group in GROUPS for k, v in group.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: (lambda spark, sf_dir, f=f: f(Relations(spark, sf_dir))) for k, (f, _) in registered().items()}
    return found | {k: f for k, (f, _) in stream_queries.STREAMS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: oracle(sql) for k, (_, sql) in (registered() | stream_queries.STREAMS).items() if sql}
