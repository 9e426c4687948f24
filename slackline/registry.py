"""All queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slackline import queries_association, queries_interchange, queries_more, queries_networks, queries_pairing, queries_reconcile, queries_records, queries_rest, queries_spatial

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (queries_networks, queries_spatial, queries_pairing, queries_association, queries_records, queries_more, queries_rest, queries_interchange, queries_reconcile)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["gr14_cpm_schedule"](spark, sf_dir)
