"""Reconciliation of reconstructed networks: who is an activity, which edges stay, and what state the network is in.

Candidates: network_id, node_id, seq, activity_id, label, x, y, width, height, confidence, duration, status (CONFIRMED, INFERRED
or REVIEW_REQUIRED), n_texts (text regions behind it). Dependencies: network_id, source, target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.operators import graph, schedule


def connected(candidates: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Candidates with the in- and out-degree of their ids."""
    ends = [dependencies.groupBy("network_id", F.col(end).alias("activity_id")).agg(F.count("*").alias(name)) for end, name in (("target", "in_degree"), ("source", "out_degree"))]
    rows = candidates.join(ends[0], ["network_id", "activity_id"], "left").join(ends[1], ["network_id", "activity_id"], "left")
    return rows.fillna(0, ["in_degree", "out_degree"])


def terminals(rows: DataFrame) -> DataFrame:
    """connected() rows with is_start and is_finish: a keyword in the label, or, for nodes without an id of their own, degrees or a lonely corner."""
    label = F.upper(F.trim(F.coalesce("label", F.lit(""))))
    named = F.length("activity_id").between(1, 3) & F.col("activity_id").rlike(r"^\p{L}") & ~F.col("activity_id").startswith("INFERRED_") & (F.col("n_texts") > 0)
    own = F.coalesce(named, F.lit(False))
    start, finish = label.rlike("START|BEGIN"), label.rlike("FINISH|END")
    many_out, many_in = ~own & (F.col("in_degree") == 0) & (F.col("out_degree") >= 3), ~own & (F.col("out_degree") == 0) & (F.col("in_degree") >= 3)
    centre = {"x": F.col("x") + F.col("width") / 2, "y": F.col("y") + F.col("height") / 2}
    place = {}
    for c, v in centre.items():
        low, high = F.min(v).over(W.partitionBy("network_id")), F.max(v).over(W.partitionBy("network_id"))
        place[c] = (v - low) / F.when(high > low, high - low).otherwise(1.0)
    lonely = ~own & ~start & ~finish & ~many_out & ~many_in & (F.col("in_degree") + F.col("out_degree") <= 1)
    first, last = lonely & (place["x"] < 0.1) & (place["y"] < 0.1), lonely & (place["x"] > 0.9) & (place["y"] > 0.9)
    return rows.withColumn("is_start", start | many_out | (first & (F.col("in_degree") == 0))).withColumn("is_finish", finish | many_in | (last & (F.col("out_degree") == 0)))


def similarity(rows: DataFrame) -> DataFrame:
    """With similarity (0 to 1) of each box to the commonest size of its network's boxes; networks of fewer than three boxes give 0.5."""
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    aspect = F.col("width") / F.col("height")
    ordered = lambda v: F.array_sort(F.collect_list(F.when(sized, v)))
    stats = rows.groupBy("network_id").agg(F.count_if(sized).cast("int").alias("n"), ordered(F.col("width")).alias("w"), ordered(F.col("height")).alias("h"), ordered(aspect).alias("r"))
    low, high = F.expr("if(n >= 4, n div 4, 0)").cast("int"), F.expr("if(n >= 4, 3 * n div 4, n - 1)").cast("int")
    stats = stats.select("network_id", "n", *[F.get(c, k).alias(f"{c}{name}") for c in "wh" for name, k in (("1", low), ("3", high))], F.get("r", F.expr("cast(n div 2 as int)")).alias("r2"))

    def off_side(c: str, q: str):
        v, small, large = F.col(c), F.col(f"{q}1"), F.col(f"{q}3")
        return F.when((v < small * 0.3) | (v > large * 3.0), 0.4).when((v < small * 0.5) | (v > large * 2.0), 0.2).otherwise(0.0)

    ratio = aspect / F.col("r2")
    off_aspect = F.when((ratio < 0.3) | (ratio > 3.0), 0.3).when((ratio < 0.5) | (ratio > 2.0), 0.15).otherwise(0.0)
    value = F.when(F.col("n") < 3, 0.5).when(~sized, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off_side("width", "w") - off_side("height", "h") - F.coalesce(off_aspect, F.lit(0.0))))
    return rows.join(stats, "network_id").withColumn("similarity", F.round(value, 9)).drop("n", "w1", "w3", "h1", "h3", "r2")


def verdicts(candidates: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Candidates with degrees, is_start, is_finish, similarity and verdict.

    Two signals against a box make it a likely false positive, one asks for a review; missing arrows or texts count for
    nothing. Terminals, and activities that share an id, go to review."""
    rows = similarity(terminals(connected(candidates, dependencies)))
    area = F.col("width") * F.col("height")
    against = (F.col("similarity") < 0.4).cast("int") + (F.col("confidence") < 0.15).cast("int") + (area < 100).cast("int")
    shared = (F.count("*").over(W.partitionBy("network_id", "activity_id")) > 1) & ~F.col("activity_id").startswith("INFERRED_")
    found = F.when(F.col("is_start") | F.col("is_finish") | (against == 1), "REVIEW_REQUIRED").when(against >= 2, "LIKELY_FALSE_POSITIVE").when(shared, "REVIEW_REQUIRED").otherwise("LIKELY_REAL")
    return rows.withColumn("verdict", found)


def reconciled(judged: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """verdicts() rows and all dependencies -> activities that stay, dependencies that stay, and a row for each network:
    counts, edges removed, consistency, cpm_status, project_duration and status."""
    real = judged.filter("verdict <> 'LIKELY_FALSE_POSITIVE'").select("network_id", "activity_id").distinct()
    kept = judged.join(real, ["network_id", "activity_id"], "left_semi")
    inner = dependencies.select("network_id", "source", "target")
    for end in ("source", "target"):
        inner = inner.join(real.withColumnRenamed("activity_id", end), ["network_id", end], "left_semi")
    counted = inner.groupBy("network_id", "source", "target").agg(F.count("*").alias("n"))
    edges = counted.filter("source <> target").select("network_id", "source", "target")
    removed = counted.groupBy("network_id").agg(F.sum(F.when(F.col("source") == F.col("target"), F.col("n")).otherwise(0)).alias("removed_self_arrows"), F.sum(F.when(F.col("source") != F.col("target"), F.col("n") - 1).otherwise(0)).alias("removed_duplicates"), F.count_if(F.col("source") != F.col("target")).alias("preserved"))
    ids = kept.groupBy("network_id", "activity_id").agg(F.min("seq").alias("seq"), F.min("duration").alias("duration"), F.count("*").alias("holders"))
    touched = edges.select("network_id", F.col("source").alias("activity_id")).union(edges.select("network_id", "target")).distinct().withColumn("touched", F.lit(True))
    state = ids.join(touched, ["network_id", "activity_id"], "left").groupBy("network_id").agg(F.max(F.col("touched").isNull()).alias("isolated"), F.max(F.col("duration") <= 0).alias("blank"), F.max(F.col("holders") > 1).alias("shared"))
    state = state.join(graph.acyclic(ids, edges), "network_id")
    consistency = F.when(~F.col("is_dag"), "HAS_CYCLES").when(F.col("isolated"), "HAS_ISOLATED_NODES").otherwise("VALID")
    state = state.withColumn("consistency", consistency)
    cpm = F.when((F.col("consistency") != "VALID") | F.col("blank"), "REVIEW_REQUIRED").when(F.col("shared"), "ERROR").otherwise("VALID")
    state = state.withColumn("cpm_status", cpm)
    runnable = state.filter("cpm_status = 'VALID'").select("network_id")
    durations = schedule.summary(schedule.schedule(ids.join(runnable, "network_id", "left_semi"), edges.join(runnable, "network_id", "left_semi"))).select("network_id", "project_duration")
    false = F.col("verdict") == "LIKELY_FALSE_POSITIVE"
    n = lambda cond, name: F.count_if(cond).alias(name)
    counts = judged.groupBy("network_id").agg(
        F.count("*").alias("candidates"), n(~false & (F.col("status") == "CONFIRMED"), "confirmed"), n(~false & (F.col("status") == "INFERRED"), "inferred"),
        n(~false & ~F.col("status").isin("CONFIRMED", "INFERRED"), "review_required"), n(false, "false_positives"),
    )
    rows = counts.join(removed, "network_id", "left").join(state, "network_id", "left").join(durations, "network_id", "left").fillna(0, ["removed_self_arrows", "removed_duplicates", "preserved"])
    rows = rows.withColumns({"consistency": F.coalesce("consistency", F.lit("VALID")), "cpm_status": F.coalesce("cpm_status", F.lit("ERROR"))})  # nothing stays
    status = F.when((F.col("false_positives") > 0) | (F.col("review_required") > 0), "REVIEW_REQUIRED").when((F.col("consistency") == "VALID") & (F.col("confirmed") > 0), "COMPLETE").otherwise("PARTIAL")
    names = ("network_id", "candidates", "confirmed", "inferred", "review_required", "false_positives", "removed_self_arrows", "removed_duplicates", "preserved", "consistency", "cpm_status", "project_duration")
    return kept, edges, rows.select(*names, status.alias("status"))
