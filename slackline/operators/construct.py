"""Networks built in bulk from structured rows, and the path from there to a schedule.

A row a network: activities array<struct<activity_id, duration, ...>>, dependencies array<struct<source, target>>, for
event networks also nodes array<struct<node_id, label>>. What construction refuses comes back as issues; a network with any has no tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.operators import schedule, validate
from slackline.plans.iterate import cut


def flat(networks: DataFrame, column: str) -> DataFrame:
    return networks.select("network_id", F.posexplode(column).alias("seq", "x")).select("network_id", (F.col("seq") + 1).alias("seq"), "x.*")


def accepted(networks: DataFrame, issues: DataFrame) -> DataFrame:
    return networks.join(issues.select("network_id").distinct(), "network_id", "left_anti")


def activity_networks(networks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """activities, dependencies (activity to activity) and issues."""
    activities, dependencies = flat(networks, "activities"), flat(networks, "dependencies")
    empty = networks.filter(F.size(F.coalesce("activities", F.array())) == 0)
    issues = cut(validate.union([validate.builder_issues(activities, dependencies), validate.issue(empty, "empty_graph")]))
    return accepted(activities, issues), accepted(dependencies, issues), issues


def event_networks(networks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, activities on arrows (source_node, target_node), dependencies (node to node) and issues."""
    nodes, activities, dependencies = (flat(networks, c) for c in ("nodes", "activities", "dependencies"))
    as_vertices = nodes.withColumnRenamed("node_id", "activity_id").withColumn("duration", F.lit(None).cast("double"))
    twice = nodes.groupBy("network_id", "node_id").agg(F.count("*").alias("n")).filter("n > 1")
    own = validate.builder_issues(activities, dependencies.filter("false"))
    edges = validate.builder_issues(as_vertices.dropDuplicates(["network_id", "activity_id"]), dependencies)
    empty = networks.filter(F.size(F.coalesce("nodes", F.array())) == 0)
    issues = cut(validate.union([own, edges, validate.issue(twice, "duplicate_node", F.col("node_id")), validate.issue(empty, "empty_graph")]))
    return accepted(nodes, issues), accepted(activities, issues), accepted(dependencies, issues), issues


def calculated(networks: DataFrame) -> DataFrame:
    """network_id, gate (REFUSED, INVALID or RUNNABLE) and project_duration where it can be run: construction, checks, then the schedule."""
    activities, dependencies, refused = activity_networks(cut(networks))
    activities, dependencies = cut(activities), cut(dependencies)  # every check reads them
    checked = validate.graph_status(activities, dependencies).select("network_id", "status")
    valid = checked.filter("status = 'VALID'").select("network_id")
    durations = schedule.summary(schedule.schedule(activities.join(valid, "network_id", "left_semi"), dependencies.join(valid, "network_id", "left_semi"))).select("network_id", "project_duration")
    marked = networks.select("network_id").join(refused.select("network_id").distinct().withColumn("refused", F.lit(True)), "network_id", "left").join(checked, "network_id", "left").join(durations, "network_id", "left")
    gate = F.when(F.col("refused"), "REFUSED").when(F.col("status") == "VALID", "RUNNABLE").otherwise("INVALID")
    return marked.select("network_id", gate.alias("gate"), "project_duration")
