"""Detected event networks against annotations: circles by place, arrows by the events at their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.functions import geometry as g
from slackline.operators import metrics, spatial

#: How far beyond 1.4 radii an arrow's end may lie from an event's centre.
MARGIN = 15.0


def nearest_events(points: DataFrame, events: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and event_id of the nearest event whose 1.4 radii and margin reach the point; points without one have no row.

    events: network_id, event_id, seq, cx, cy, radius. They are listed under the grid cells that they reach."""
    size = 100.0
    reach = 1.4 * F.col("radius") + MARGIN
    listed = events.withColumn("cell", F.explode(spatial.cells(F.col("cx") - reach, F.col("cx") + reach, F.col("cy") - reach, F.col("cy") + reach, size)))
    at = points.withColumn("cell", F.concat_ws(":", F.floor(F.col(x) / size), F.floor(F.col(y) / size)))
    far = g.distance(g.Point(F.col(x), F.col(y)), g.Point(F.col("cx"), F.col("cy")))
    near = at.join(listed.select("network_id", "cell", "event_id", F.col("seq").alias("event_seq"), "cx", "cy", "radius"), ["network_id", "cell"]).withColumn("far", far).filter(F.col("far") <= 1.4 * F.col("radius") + MARGIN)
    return near.groupBy(*keys).agg(F.min(F.struct(F.round("far", 9).alias("far"), "event_seq", "event_id")).alias("m")).select(*keys, F.col("m.event_id").alias("event_id"))


def arrow_pairs(arrows: DataFrame, events: DataFrame) -> DataFrame:
    """network_id, arrow_id, source, target: the events at both ends, null where none is near. An arrow that points left (dx < 0) runs from its second end."""
    turned = F.coalesce(F.col("dx") < 0, F.lit(False))
    end = lambda c, a, b: F.when(turned, F.col(f"{c}{a}")).otherwise(F.col(f"{c}{b}"))
    rows = arrows.select("network_id", "arrow_id", end("x", 2, 1).alias("tx"), end("y", 2, 1).alias("ty"), end("x", 1, 2).alias("hx"), end("y", 1, 2).alias("hy"))
    keys = ["network_id", "arrow_id"]
    tails, heads = nearest_events(rows, events, keys, "tx", "ty"), nearest_events(rows, events, keys, "hx", "hy")
    return rows.select(*keys).join(tails.withColumnRenamed("event_id", "source"), keys, "left").join(heads.withColumnRenamed("event_id", "target"), keys, "left")


def compare(truth: DataFrame, edges: DataFrame, detected: DataFrame, arrows: DataFrame) -> DataFrame:
    """A row a network: events matched, arrows mapped and unresolved, and precision, recall and F1 of both.

    truth, detected: network_id, node_id, seq, x, y, width, height of circles; edges: network_id, source, target by truth's ids."""
    matched = spatial.greedy_matching(spatial.admissible_pairs(truth, detected))
    nodes = metrics.node_accuracy(truth, detected, matched).select("network_id", F.col("expected").alias("expected_events"), F.col("found").alias("detected_events"), F.col("tp").alias("matched_events"), F.col("f1").alias("event_f1"))
    events = detected.select("network_id", F.col("node_id").alias("event_id"), "seq", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"), ((F.col("width") + F.col("height")) / 4).alias("radius"))
    pairs = arrow_pairs(arrows, events)
    for end in ("source", "target"):
        to = matched.select("network_id", F.col("det_id").alias(end), F.col("gt_id").alias(f"gt_{end}"))
        pairs = pairs.join(to, ["network_id", end], "left")
    resolved = F.col("gt_source").isNotNull() & F.col("gt_target").isNotNull()
    counts = pairs.groupBy("network_id").agg(F.count("*").alias("arrows"), F.count_if(resolved).alias("mapped_arrows"), F.count_if(~resolved).alias("unresolved_arrows"))
    found = pairs.filter(resolved).select("network_id", F.col("gt_source").alias("source"), F.col("gt_target").alias("target"))
    arcs = metrics.edge_accuracy(edges, found).select("network_id", F.col("precision").alias("arrow_precision"), F.col("recall").alias("arrow_recall"), F.col("f1").alias("arrow_f1"), "direction_accuracy")
    return nodes.join(counts, "network_id", "left").join(arcs, "network_id", "left").fillna(0, ["arrows", "mapped_arrows", "unresolved_arrows"])


def nearest_truth(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """network_id, node_id, gt_id: the annotated position (network_id, gt_id, seq, gx, gy) with the least squared distance to a node's centre, the first of equals."""
    dx: Column = F.col("gx") - F.col("x") - F.col("width") / 2
    dy: Column = F.col("gy") - F.col("y") - F.col("height") / 2
    rows = detected.select("network_id", "node_id", "x", "y", "width", "height").join(truth.withColumnRenamed("seq", "gt_seq"), "network_id")
    best = F.min(F.struct(F.round(dx * dx + dy * dy, 9).alias("far"), "gt_seq", "gt_id"))
    return rows.groupBy("network_id", "node_id").agg(best.alias("m")).select("network_id", "node_id", F.col("m.gt_id").alias("gt_id"))
