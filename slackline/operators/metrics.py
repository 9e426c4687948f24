"""Accuracy of detected networks against ground truth, a row a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.functions.numbers import half_even, prf


def edge_accuracy(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Directed and undirected precision, recall and F1, and direction accuracy of shared pairs. Edges count once each."""
    t = truth.select("network_id", "source", "target").distinct().withColumn("in_truth", F.lit(1))
    d = detected.select("network_id", "source", "target").distinct().withColumn("in_detected", F.lit(1))
    both = t.join(d, ["network_id", "source", "target"], "full").fillna(0, ["in_truth", "in_detected"])
    pair = both.withColumn("low", F.least("source", "target")).withColumn("high", F.greatest("source", "target"))
    # a pair's expected direction is low -> high when the truth has it
    pair = pair.groupBy("network_id", "low", "high").agg(
        F.sum("in_truth").alias("t"), F.sum("in_detected").alias("d"), F.sum(F.col("in_truth") * F.col("in_detected")).alias("tp"),
    )
    shared = (F.col("t") > 0) & (F.col("d") > 0)
    total = pair.groupBy("network_id").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("expected_edges"), F.sum("d").alias("detected_edges"),
        F.count_if(shared).alias("pair_tp"), F.count_if(F.col("t") > 0).alias("pair_expected"), F.count_if(F.col("d") > 0).alias("pair_detected"),
        F.count_if(shared & (F.col("tp") > 0)).alias("direction_ok"),
    )
    p, r, f = prf(F.col("tp"), F.col("detected_edges"), F.col("expected_edges"))
    up, ur, uf = prf(F.col("pair_tp"), F.col("pair_detected"), F.col("pair_expected"))
    direction = half_even(F.col("direction_ok") / F.nullif(F.col("pair_tp"), F.lit(0)), 4)
    return total.select("network_id", "expected_edges", "detected_edges", p.alias("precision"), r.alias("recall"), f.alias("f1"), up.alias("pair_precision"), ur.alias("pair_recall"), uf.alias("pair_f1"), direction.alias("direction_accuracy"))


def duration_accuracy(matched: DataFrame) -> DataFrame:
    """matched (network_id, truth, detected): exact matches, mean absolute and mean relative error; rows without either do not count."""
    both = matched.filter("truth is not null and detected is not null").withColumn("error", F.abs(F.col("truth") - F.col("detected")))
    return both.groupBy("network_id").agg(
        F.count("*").alias("compared"),
        F.count_if(F.col("error") < 1e-9).alias("exact_matches"),
        half_even(F.avg((F.col("error") < 1e-9).cast("double")), 4).alias("exact_match_accuracy"),
        half_even(F.avg("error"), 4).alias("mean_abs_error"),
        half_even(F.avg(F.when(F.col("truth") != 0, F.col("error") / F.abs("truth"))), 4).alias("mean_relative_error"),
    )


def id_accuracy(matched: DataFrame) -> DataFrame:
    """matched (network_id, truth_id, detected_id): equal but for case and outer blanks."""
    rows = matched.filter("trim(truth_id) <> ''")
    same = F.lower(F.trim("truth_id")) == F.lower(F.trim(F.coalesce("detected_id", F.lit(""))))
    return rows.groupBy("network_id").agg(F.count("*").alias("compared"), half_even(F.avg(same.cast("double")), 4).alias("id_accuracy"))


def node_accuracy(truth: DataFrame, detected: DataFrame, matched: DataFrame) -> DataFrame:
    """Precision, recall and F1 of matched nodes."""
    n = lambda rows, name: rows.groupBy("network_id").agg(F.count("*").alias(name))
    rows = n(truth, "expected").join(n(detected, "found"), "network_id", "full").join(n(matched, "tp"), "network_id", "left").fillna(0)
    p, r, f = prf(F.col("tp"), F.col("found"), F.col("expected"))
    return rows.select("network_id", "expected", "found", "tp", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def mean_metrics(rows: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Means over networks with equal weight; nulls do not count."""
    return rows.groupBy(group).agg(*[half_even(F.avg(n), 4).alias(n) for n in names], *[F.count(n).alias(f"{n}_count") for n in names])


def benchmark(runs: DataFrame, stages: DataFrame, edges: DataFrame) -> DataFrame:
    """runs (image, status, outcome), stages (image, stage, failure_class) and edge_accuracy() of the annotated ones, joined to a row an image."""
    accuracy = edges.select(F.col("network_id").alias("image"), F.col("f1").alias("dependency_f1"), "direction_accuracy")
    return runs.join(stages, "image").join(accuracy, "image", "left").select("image", "status", "outcome", "stage", "failure_class", "dependency_f1", "direction_accuracy")
