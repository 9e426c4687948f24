"""Counts, rankings and set operations over networks, a row a network unless other keys are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = ["network_id", "activity_id"]


def confidences(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least, largest and mean confidence, nulls left out."""
    c = F.col("confidence")
    return rows.groupBy(*(keys or ["network_id"])).agg(F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.avg(c), 9).alias("mean"))


def text_confidences(regions: DataFrame, high: float = 0.7) -> DataFrame:
    """Mean confidence of text regions and how many are sure."""
    return regions.groupBy("network_id").agg(F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.count_if(F.col("confidence") >= high).alias("high"))


def diagram_confidence(*elements: DataFrame) -> DataFrame:
    """Mean confidence over the elements of all tables."""
    rows = elements[0].select("network_id", "confidence")
    for e in elements[1:]:
        rows = rows.unionByName(e.select("network_id", "confidence"))
    return rows.groupBy("network_id").agg(F.round(F.avg("confidence"), 9).alias("confidence"))


def status_counts(rows: DataFrame, keys: list[str | Column], conditions: dict[str, Column]) -> DataFrame:
    """How many rows of each key meet each named condition, and their number."""
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()], F.count("*").alias("total"))


def stage_metrics(rows: DataFrame, keys: list[str | Column], counts: list[str]) -> DataFrame:
    """For each count of a stage (null where the stage did not report): reports, mean and largest."""
    return rows.groupBy(*keys).agg(*[f(c).alias(f"{name}_{c}") for c in counts for name, f in (("reports", F.count), ("mean", F.avg), ("largest", F.max))])


def stage_progression(rows: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """Counts of stages as rows (key, stage, n) in the order of the stages."""
    return rows.unpivot(key, stages, "stage", "n")


def count_comparison(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of two tables by network: expected, found, off, ratio (null where nothing is expected); networks of either table."""
    n = lambda rows, name: rows.groupBy("network_id").agg(F.count("*").alias(name))
    both = n(expected, "expected").join(n(found, "found"), "network_id", "full").fillna(0, ["expected", "found"])
    return both.withColumn("off", F.abs(F.col("expected") - F.col("found"))).withColumn("ratio", F.bround(F.col("found") / F.nullif(F.col("expected"), F.lit(0)), 4))


def top_k(rows: DataFrame, k: int, order: list, keys: list[str] | None = None) -> DataFrame:
    """The first k rows of each key in an order that leaves no ties, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*(keys or ["network_id"])).orderBy(*order))).filter(F.col("rank") <= k)


def without_edges(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Activities that no edge touches."""
    touched = dependencies.select("network_id", F.col("source").alias("activity_id")).union(dependencies.select("network_id", "target"))
    return activities.select(*KEY).join(touched, KEY, "left_anti")


def without_predecessors(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    return activities.select(*KEY).subtract(dependencies.select("network_id", "target"))


def comparable(annotated: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Annotated activities that are not marked uncertain."""
    return annotated.select(*KEY).join(uncertain.select(*KEY), KEY, "left_anti")


def collisions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids (network_id, id) that two kinds of elements share."""
    return left.select("network_id", "id").intersect(right.select("network_id", "id"))


def first_edges(dependencies: DataFrame) -> DataFrame:
    """For each smaller end of an edge, its edge with the smallest other end, then source."""
    first = dependencies.groupBy("network_id", F.least("source", "target").alias("a")).agg(F.min(F.struct(F.greatest("source", "target").alias("b"), "source", "target")).alias("m"))
    return first.select("network_id", "m.source", "m.target")
