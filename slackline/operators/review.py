"""Review decisions as an append-only log, replayed by set operations.

An item starts PENDING. Its first effective decision (ACCEPT, CORRECT with a value, REJECT) settles it; later
ones change nothing; LEAVE_UNRESOLVED and unknown words leave it pending. Order is by ts, then seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.operators import batches, schedule, validate
from slackline.plans.iterate import cut

# Decisions and the status they give.
STATUS = {"ACCEPT": "ACCEPTED", "CORRECT": "CORRECTED", "REJECT": "REJECTED"}


def effective(log: DataFrame) -> DataFrame:
    """Log rows that can settle an item."""
    return log.filter(F.col("decision").isin(*STATUS) & ((F.col("decision") != "CORRECT") | F.col("corrected_value").isNotNull()))


def settled(log: DataFrame) -> DataFrame:
    """item_id, status, corrected_value, ts of each item's first effective decision; a partial minimum, no sort of the log."""
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    first = effective(log).groupBy("item_id").agg(F.min(F.struct("ts", "seq", "decision", "corrected_value")).alias("d"))
    return first.select("item_id", status[F.col("d.decision")].alias("status"), "d.corrected_value", "d.ts")


def statuses(items: DataFrame, log: DataFrame) -> DataFrame:
    """Every item with its status; those without effective decision are PENDING."""
    return items.select("item_id").distinct().join(settled(log), "item_id", "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


def overlay(values: DataFrame, log: DataFrame) -> DataFrame:
    """values (item_id, value) after review: rejected rows go, corrected ones change, others stay."""
    joined = values.join(settled(log).select("item_id", "status", "corrected_value"), "item_id", "left")
    kept = joined.filter(F.coalesce("status", F.lit("PENDING")) != "REJECTED")
    return kept.select("item_id", F.when(F.col("status") == "CORRECTED", F.col("corrected_value")).otherwise(F.col("value")).alias("value"), F.coalesce("status", F.lit("PENDING")).alias("status"))


def usable(log: DataFrame) -> DataFrame:
    """Log rows that can decide an edge."""
    return log.filter(F.col("decision").isin("ACCEPT", "REJECT", "REVERSE") | (F.col("decision").isin("CHANGE_SOURCE", "CHANGE_TARGET") & F.col("new_end").isNotNull()))


def decided_edges(edges: DataFrame, log: DataFrame) -> DataFrame:
    """edges (item_id, source, target) with log decisions ACCEPT, REJECT, REVERSE, CHANGE_SOURCE, CHANGE_TARGET (new_end) applied, first one first."""
    first = usable(log).groupBy("item_id").agg(F.min(F.struct("ts", "seq", "decision", "new_end")).alias("d")).select("item_id", "d.decision", "d.new_end")
    rows = edges.join(first, "item_id", "left").filter(F.coalesce("decision", F.lit("")) != "REJECT")
    d = F.col("decision")
    source = F.when(d == "REVERSE", F.col("target")).when(d == "CHANGE_SOURCE", F.col("new_end")).otherwise(F.col("source"))
    target = F.when(d == "REVERSE", F.col("source")).when(d == "CHANGE_TARGET", F.col("new_end")).otherwise(F.col("target"))
    return rows.select("item_id", source.alias("source"), target.alias("target"), F.coalesce(d, F.lit("PENDING")).alias("decision"))


def merged_edges(automatic: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """Edges of both origins once each; those of either alone keep their origin, shared ones count as reviewed. conflicts: repeats among reviewed edges."""
    a = automatic.select(*key).distinct().withColumn("auto", F.lit(1)).withColumn("review", F.lit(0))
    r = reviewed.select(*key).withColumn("auto", F.lit(0)).withColumn("review", F.lit(1))
    rows = a.unionByName(r).groupBy(*key).agg(F.max("auto").alias("auto"), F.sum("review").alias("review"))
    return rows.select(*key, F.when(F.col("review") > 0, "review").otherwise("automatic").alias("origin"), (F.col("review") > 1).alias("is_conflict"))


def summary(items: DataFrame, log: DataFrame) -> DataFrame:
    return statuses(items, log).groupBy("status").agg(F.count("*").alias("items"))


def apply(activities: DataFrame, dependencies: DataFrame, id_log: DataFrame, edge_log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Activities, dependencies and issues after review.

    id_log: item_id is network_id:activity_id, corrected_value the new id (text). Rejected activities and their edges go, corrected
    ids are carried to edge ends. edge_log as in decided_edges(), items network_id:source>target. Two activities that come to one id are an issue
    (duplicate_activity_id), and so are repeats among reviewed edges (duplicate_edge); unreviewed repeats collapse."""
    item = F.concat_ws(":", F.col("network_id").cast("string"), "activity_id")
    fixed = settled(id_log).select("item_id", "status", F.col("corrected_value").alias("new_id"))
    acts = activities.withColumn("item_id", item).join(fixed, "item_id", "left").filter("coalesce(status, '') <> 'REJECTED'")
    acts = acts.withColumn("raw_id", F.col("activity_id")).withColumn("activity_id", F.coalesce("new_id", "activity_id")).drop("item_id", "status", "new_id")
    final = acts.select("network_id", "raw_id", F.col("activity_id").alias("final_id"))
    edges = dependencies.withColumn("item_id", F.concat(F.col("network_id").cast("string"), F.lit(":"), "source", F.lit(">"), "target"))
    decided = decided_edges(edges, edge_log).join(edges.select("item_id", "network_id").distinct(), "item_id")
    for end in ("source", "target"):
        # an end that no activity holds any more drops its edge
        decided = decided.join(final.select("network_id", F.col("raw_id").alias(end), F.col("final_id").alias(f"final_{end}")), ["network_id", end])
    mapped = decided.select("network_id", F.col("final_source").alias("source"), F.col("final_target").alias("target"), "decision")
    merged = merged_edges(mapped.filter("decision = 'PENDING'"), mapped.filter("decision <> 'PENDING'"), ["network_id", "source", "target"])
    twice = acts.groupBy("network_id", "activity_id").agg(F.count("*").alias("n")).filter("n > 1")
    issues = twice.select("network_id", F.lit("duplicate_activity_id").alias("code"), F.col("activity_id").alias("element")).unionByName(
        merged.filter("is_conflict").select("network_id", F.lit("duplicate_edge").alias("code"), F.concat_ws("->", "source", "target").alias("element"))
    )
    return acts.drop("raw_id"), merged.select("network_id", "source", "target"), issues


def scheduled(activities: DataFrame, dependencies: DataFrame, id_log: DataFrame, edge_log: DataFrame, fold_limit: int = schedule.FOLD_LIMIT) -> DataFrame:
    """schedule.summary() of the networks that after review have no issue of apply() and none of validate.graph_issues().

    Logs as in apply(), each row with its network_id: networks of at most fold_limit vertices are reviewed, checked and scheduled within
    their row, larger ones by joins."""
    tables = activities, dependencies, effective(id_log), usable(edge_log)
    large = activities.groupBy("network_id").count().filter(F.col("count") > fold_limit).select("network_id")
    if large.isEmpty():
        return batches.reviewed_totals(*tables, schedule.TOLERANCE)
    large = cut(large)
    small, rest = ([t.join(large, "network_id", how) for t in tables] for how in ("left_anti", "left_semi"))
    return batches.reviewed_totals(*small, schedule.TOLERANCE).unionByName(joined_schedules(*rest))


def joined_schedules(activities: DataFrame, dependencies: DataFrame, id_log: DataFrame, edge_log: DataFrame) -> DataFrame:
    """The same by joins, for networks of any size."""
    acts, deps, issues = map(cut, apply(activities, dependencies, id_log, edge_log))
    valid = validate.graph_status(acts, deps).filter("status = 'VALID'").join(issues, "network_id", "left_anti").select("network_id")
    return schedule.summary(schedule.schedule(acts.join(valid, "network_id", "left_semi"), deps.join(valid, "network_id", "left_semi")))
