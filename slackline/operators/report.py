"""Report tables: results, summaries and the long form of sections; precedence of event networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.functions.numbers import plain_number
from slackline.operators import graph

#: The sections of a report, in order.
SECTIONS = ("summary", "activities", "dependencies", "critical_paths", "cpm", "pert", "validation", "review")


def results(scheduled: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Every scheduled activity with its sorted predecessors and successors."""
    return graph.adjacency(scheduled, dependencies)


def summary(scheduled: DataFrame, dependencies: DataFrame) -> DataFrame:
    edges = dependencies.groupBy("network_id").agg(F.count("*").alias("dependency_count"))
    totals = scheduled.groupBy("network_id").agg(F.count("*").alias("activity_count"), F.max("project_duration").alias("project_duration"), F.count_if("is_critical").alias("critical_count"))
    return totals.join(edges, "network_id", "left").withColumn("dependency_count", F.coalesce("dependency_count", F.lit(0))).select("network_id", "activity_count", "dependency_count", "project_duration", "critical_count")


def long_form(rows: DataFrame, section: str, names: list[str]) -> DataFrame:
    """network_id, section, activity_id, name, value: a row for each named number, written plainly."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), plain_number(F.col(n).cast("double")).alias("value")) for n in names])
    flat = rows.select("network_id", F.lit(section).alias("section"), "activity_id", F.explode(cells).alias("c"))
    return flat.select("network_id", "section", "activity_id", "c.name", "c.value")


def event_precedence(arrows: DataFrame) -> DataFrame:
    """Activities on arrows (network_id, activity_id, from_event, to_event, confidence) -> dependencies by shared events.

    Pairs that follow from both directions need a review."""
    p = arrows.select("network_id", F.col("activity_id").alias("source"), F.col("to_event").alias("event"), F.col("confidence").alias("c1"))
    s = arrows.select("network_id", F.col("activity_id").alias("target"), F.col("from_event").alias("event"), F.col("confidence").alias("c2"))
    edges = p.join(s, ["network_id", "event"]).filter("source <> target").groupBy("network_id", "source", "target").agg(F.min(F.least("c1", "c2")).alias("confidence"))
    back = edges.select("network_id", F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("back"))
    return edges.join(back, ["network_id", "source", "target"], "left").select("network_id", "source", "target", "confidence", F.col("back").isNotNull().alias("needs_review"))


def sort_keys(column: str, numeric: bool, descending: bool = False) -> list:
    """Order of a results table by one of its columns: numbers as numbers with missing ones last (first when descending), other columns as text."""
    key = F.coalesce(F.col(column).try_cast("double"), F.lit(float("inf"))) if numeric else F.coalesce(F.col(column).cast("string"), F.lit(""))
    return [key.desc() if descending else key.asc()]
