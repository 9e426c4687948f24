"""Verdicts from collected evidence: diagram types, ids, durations, outcomes, first abnormal stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import text


def _evidence(own: Column, other: Column, total: Column, spread: Column) -> Column:
    count = F.when(own >= 3, 0.3).when(own >= 2, 0.2).when(own >= 1, 0.1).otherwise(0.0)
    against = F.when(other > own, 0.2).when(other > 0, 0.1).otherwise(0.0)
    even = F.when((spread < 0.3) & (own >= 2), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.when(total > 0, own / total * 0.4).otherwise(0.0) + count - against + even)


def diagram_types(counts: DataFrame) -> DataFrame:
    """counts (network_id, rectangles, circles, polygons, cv) -> network_id, diagram_type, confidence."""
    r, c = F.col("rectangles"), F.col("circles")
    total = r + c + F.col("polygons")
    rows = counts.withColumn("aon", _evidence(r, c, total, F.col("cv"))).withColumn("aoa", _evidence(c, r, total, F.col("cv"))).withColumn("total", total)
    rows = rows.withColumn("both", F.col("aon") + F.col("aoa"))
    share = lambda c: F.when(F.col("both") > 0, F.col(c) / F.col("both")).otherwise(0.0)
    rows = rows.withColumns({"aon": share("aon"), "aoa": share("aoa")})
    a, o = F.col("aon"), F.col("aoa")
    kind = F.when(F.col("total") < 2, "UNKNOWN").when((a > o) & (a > 0.3), "AON").when((o > a) & (o > 0.3), "AOA").otherwise("UNKNOWN")
    return rows.select("network_id", kind.alias("diagram_type"), F.when(F.col("total") < 2, 0.0).otherwise(F.greatest(a, o)).alias("confidence"))


def resolved_ids(rows: DataFrame) -> DataFrame:
    """node_id, raw, confidence, alternatives array<struct<id, confidence>> -> resolved_id, source, status.

    0.70 accepts the raw id; below, the best valid alternative of 0.30 or more is preferred, then a raw single letter."""
    raw = F.upper("raw")
    valid = raw.rlike("^[A-Z]$")
    usable = F.filter("alternatives", lambda a: a["id"].rlike("^[A-Z]$") & (a["confidence"] >= 0.30))
    ranked = F.array_sort(F.transform(usable, lambda a: F.struct((-a["confidence"]).alias("rank"), a["id"].alias("id"))))
    best = F.try_element_at(ranked, F.lit(1))["id"]
    high = F.col("confidence") >= 0.70
    out = rows.withColumn("best", best)
    blank = F.col("raw").isNull()
    resolved = F.when(blank, None).when(high, raw).when(F.col("best").isNotNull(), F.col("best")).when(valid, raw)
    source = F.when(blank, "REVIEW_REQUIRED").when(high, "OCR_HIGH_CONFIDENCE").when(F.col("best").isNotNull(), "OCR_ALTERNATIVE").when(valid, "OCR_HIGH_CONFIDENCE").otherwise("REVIEW_REQUIRED")
    status = F.when(source == "OCR_ALTERNATIVE", "CONTEXTUALLY_RESOLVED").when(source == "REVIEW_REQUIRED", "REVIEW_REQUIRED").otherwise("CONFIRMED")
    return out.select("node_id", resolved.alias("resolved_id"), source.alias("source"), status.alias("status"))


def unique_ids(rows: DataFrame) -> DataFrame:
    """Resolved ids (network_id, node_id, seq, raw, resolved_id, status, confidence, alternatives) made unique within each network.

    Of the nodes that claim one id (their resolved one, else the raw one) the most confident, then first, keeps it. Each other
    one, in that order, takes its best alternative that is a single letter and not used by those before it, or else needs a review."""
    ranked = F.array_sort(F.transform(F.coalesce("alternatives", F.expr("cast(array() as array<struct<id:string,confidence:double>>)")), lambda a, i: F.struct((-a["confidence"]).alias("rank"), i.alias("place"), a["id"].alias("id"))))
    options = F.filter(F.transform(ranked, lambda a: a["id"]), lambda i: i.rlike("^[A-Z]$"))
    claimed = rows.withColumn("claim", F.coalesce("resolved_id", F.nullif(F.upper("raw"), F.lit("")))).withColumn("options", options)
    node = F.struct((-F.col("confidence")).alias("rank"), "seq", "node_id", "resolved_id", "status", "options")
    groups = claimed.filter("claim is not null").groupBy("network_id", "claim").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    settled = F.expr(
        """aggregate(slice(nodes, 2, size(nodes)),
            named_struct('used', filter(array(nodes[0].resolved_id), u -> u is not null), 'out', array(named_struct('node_id', nodes[0].node_id, 'resolved_id', nodes[0].resolved_id, 'status', nodes[0].status))),
            (state, x) -> transform(array(try_element_at(filter(x.options, o -> not array_contains(state.used, o)), 1)), pick -> named_struct(
                'used', if(pick is null, state.used, array_append(state.used, pick)),
                'out', array_append(state.out, named_struct('node_id', x.node_id, 'resolved_id', pick, 'status', if(pick is null, 'REVIEW_REQUIRED', 'CONTEXTUALLY_RESOLVED')))))[0],
            state -> state.out)"""
    )
    done = groups.select("network_id", F.explode(settled).alias("n")).select("network_id", "n.*")
    return done.unionByName(claimed.filter("claim is null").select("network_id", "node_id", "resolved_id", "status"))


def suffixed_ids(rows: DataFrame, partition: list[str], order: list[str]) -> Column:
    """id for its first holder, id_1, id_2, ... for the next ones."""
    k = F.row_number().over(W.partitionBy(*partition, "id").orderBy(*order)) - 1
    return F.when(k == 0, F.col("id")).otherwise(F.concat_ws("_", "id", k))


def duration_scores(rows: DataFrame) -> DataFrame:
    """node_id, seq, value, raw_text, confidence, in_sub_crop -> with score: 0.3 confidence, 0.2 format, 0.2 range, 0.1 each whole, pure, sub-crop."""
    v, t = F.col("value"), F.trim("raw_text")
    whole = v == F.floor(v)
    written = F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))
    bonus = lambda cond, points: F.when(cond, points).otherwise(0.0)
    score = F.least(F.col("confidence"), F.lit(1.0)) * 0.3 + bonus(text.is_duration_format(F.col("raw_text")), 0.2) + bonus((v > 0) & (v <= 20), 0.2) + bonus(whole, 0.1) + bonus(t == written, 0.1) + bonus(F.col("in_sub_crop"), 0.1)
    return rows.withColumn("score", F.round(score, 9))


def resolved_durations(rows: DataFrame) -> DataFrame:
    """The best-scored candidate of each node and its status."""
    best = duration_scores(rows).withColumn("rank", F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("score"), "seq"))).filter("rank = 1")
    status = F.when(F.col("score") >= 0.60, "CONFIRMED").when(F.col("score") >= 0.30, "CONTEXTUALLY_RESOLVED").otherwise("REVIEW_REQUIRED")
    return best.select("node_id", F.col("value").alias("resolved_value"), "score", status.alias("status"))


def final_status(errors: Column, review: Column, validated: Column) -> Column:
    return F.when(errors > 0, "FAILED").when(review, "REVIEW_REQUIRED").when(validated, "SUCCESS").otherwise("FAILED")


def outcome(status: Column) -> Column:
    review = status.isin("REVIEW_REQUIRED", "NOT_SUPPORTED")
    return F.when(status == "FAILED", "FATAL_FAILURE").when(status == "SUCCESS", "AUTOMATIC_SUCCESS").when(review, "AUTOMATIC_REVIEW_REQUIRED").when(status.isNotNull(), "AUTOMATIC_REVIEW_REQUIRED").otherwise("FATAL_FAILURE")


def readiness(rows: DataFrame) -> Column:
    """Why results cannot be shown yet, or READY: has_candidate, has_workflow, pending, dirty, is_valid, gate, has_cpm."""
    c = F.col
    return (
        F.when(~c("has_candidate"), F.when(c("has_workflow"), "REVIEW_REQUIRED").otherwise("NO_ANALYSIS"))
        .when((c("pending") > 0) | c("dirty") | c("is_valid").isNull(), "REVIEW_REQUIRED")
        .when(~c("is_valid"), "GRAPH_INVALID")
        .when(F.coalesce(c("gate"), F.lit("")) != "RUNNABLE", "CPM_BLOCKED")
        .when(~c("has_cpm"), "RESULT_UNAVAILABLE")
        .otherwise("READY")
    )


#: Counts of nodes or activities from which a diagram is inflated, and the share of duplicates that explains it.
INFLATED, DUPLICATES = 40, 0.25


def first_abnormal_stage(m: DataFrame) -> DataFrame:
    """Stage metrics (nulls where unavailable) -> with stage and failure_class of the earliest abnormal signal."""
    c = F.col
    nodes, acts, labels = c("final_candidate_nodes"), c("reconstructed_activities"), c("ocr_labels")
    share = F.when(c("raw_shapes") > 0, c("duplicates_suppressed") / c("raw_shapes"))
    aoa = F.upper(F.coalesce(c("diagram_type"), F.lit(""))) == "AOA"
    inflated_acts = F.coalesce(acts >= INFLATED, F.lit(False))
    many = F.coalesce(nodes >= INFLATED, F.lit(False))
    by_count = inflated_acts & (~many | F.coalesce((nodes == 0) | (acts > nodes * 2), F.lit(False)))
    some = F.coalesce(nodes > 0, F.lit(False))
    no_arrows = F.coalesce(c("arrows_detected") == 0, F.lit(False)) | F.coalesce(c("deduplicated_arrows") == 0, F.lit(False))
    no_deps = F.coalesce(c("validated_dependencies") == 0, F.lit(False)) | F.coalesce(c("reconstructed_dependencies") == 0, F.lit(False))
    invalid = F.coalesce(~c("graph_is_valid"), F.lit(False))
    blocked = some & F.coalesce(acts > 0, F.lit(False)) & (invalid | F.coalesce(c("cpm_gate") == "BLOCKED_REVIEW", F.lit(False)))
    no_text = F.coalesce(labels == 0, F.lit(False)) & (c("ocr_regions").isNull() | (c("ocr_regions") == 0))
    few_text = F.coalesce((labels > 0) & (acts > labels * 3), F.lit(False))
    kinds = (
        (by_count & aoa, "Detecting arrows", "ARROW_DETECTION"),
        (by_count, "Reconstructing diagram", "NODE_RECONSTRUCTION"),
        (many & (share.isNull() | (share < DUPLICATES)), "Detecting shapes", "SHAPE_DETECTION"),
        (many, "Detecting shapes", "SHAPE_DEDUPLICATION"),
        (some & no_arrows, "Detecting arrows", "ARROW_DETECTION"),
        (some & no_deps & F.coalesce(labels > 0, F.lit(False)) & c("deduplicated_arrows").isNull(), "Associating text", "ARROW_DETECTION"),
        (some & no_deps & F.coalesce(labels > 0, F.lit(False)), "Associating text", "NODE_PAIRING"),
        (some & no_deps & c("deduplicated_arrows").isNull(), "Building graph", "ARROW_DETECTION"),
        (some & no_deps, "Building graph", "NODE_PAIRING"),
        (blocked & no_text, "Extracting text (OCR)", "OCR"),
        (blocked & few_text, "Associating text", "OCR"),
        (invalid, "Building graph", "GRAPH_BUILD"),
    )
    stage, failure = F.lit(None).cast("string"), F.lit("UNKNOWN")
    for cond, s, f in reversed(kinds):
        stage, failure = F.when(cond, s).otherwise(stage), F.when(cond, f).otherwise(failure)
    return m.withColumn("stage", stage).withColumn("failure_class", failure)


def bottlenecks(classified: DataFrame) -> DataFrame:
    """Failure classes by how many diagrams they explain first, most first."""
    return classified.groupBy("failure_class").agg(F.count("*").alias("image_count")).orderBy(F.desc("image_count"), "failure_class")


def ambiguities(rows: DataFrame) -> DataFrame:
    """activities (network_id, activity, activity_id, has_text) -> kind: duplicate_label, no_text, inferred_id."""
    n = F.count("*").over(W.partitionBy("network_id", "activity_id"))
    kinds = F.array(F.when(F.col("n") > 1, "duplicate_label"), F.when(~F.col("has_text"), "no_text"), F.when(F.col("activity_id").startswith("INFERRED_"), "inferred_id"))
    return rows.withColumn("n", n).withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull()))).drop("n")


def reconstruction_issues(rows: DataFrame) -> DataFrame:
    """activities (network_id, activity_id, duration, confidence) -> network_id, code, severity, element."""
    twice = rows.groupBy("network_id", "activity_id").agg(F.count("*").alias("n")).filter("n > 1")
    part = lambda r, code, severity: r.select("network_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("activity_id").alias("element"))
    return part(twice, "duplicate_activity_id", "ERROR").unionByName(part(rows.filter("duration <= 0"), "missing_duration", "WARNING")).unionByName(part(rows.filter("confidence < 0.3"), "low_confidence", "INFO"))


def review_issues(rows: DataFrame) -> DataFrame:
    """Rows that need a look, with the reasons in order."""
    reasons = F.array(F.when(F.col("confidence") < 0.5, "low_confidence"), F.when(~F.col("has_text"), "no_text"), F.when(F.col("duration") <= 0, "no_duration"))
    return rows.withColumn("issues", F.filter(reasons, lambda r: r.isNotNull())).filter(F.size("issues") > 0)


# Characters that recognition takes for one another.
CONFUSABLE = {
    "C": ["G", "O", "Q"],
    "G": ["C", "6"],
    "O": ["Q", "D", "0"],
    "Q": ["O", "D"],
    "I": ["L", "1", "l"],
    "L": ["I", "1"],
    "S": ["5", "8"],
    "Z": ["2"],
    "B": ["8", "13"],
    "D": ["O", "0"],
    "U": ["V"],
    "V": ["U", "Y"],
    "M": ["N"],
    "N": ["M"],
}


def confusable(c: Column) -> Column:
    """array<string>: what recognition may have made of a character, in order; empty for others."""
    return F.coalesce(text.lookup(CONFUSABLE, F.upper(c)), F.array().cast("array<string>"))


def topology_candidates(rows: DataFrame) -> DataFrame:
    """rows (network_id, node_id, raw, confidence, alternatives) -> candidate ids with base scores: raw 0.5, alternatives 0.8 of theirs, confusions 0.3, letters next to it 0.2; the first of equal ids counts."""
    one = lambda c, base, rank: F.struct(F.lit(rank).alias("rank"), c.alias("id"), base.alias("base"))
    raw = F.col("raw")
    step = lambda k: F.when(raw.rlike("^[A-Za-z]$"), F.char(F.ascii(F.upper(raw)) + k))
    groups = F.concat(
        F.array(one(raw, F.lit(0.5), 0)),
        F.transform("alternatives", lambda a: one(a["id"], a["confidence"] * 0.8, 1)),
        F.transform(confusable(raw), lambda c: one(c, F.lit(0.3), 2)),
        F.transform(F.filter(F.array(step(-1), step(1)), lambda c: c.rlike("^[A-Z]$")), lambda c: one(c, F.lit(0.2), 3)),
    )
    flat = rows.filter("raw is not null").select("network_id", "node_id", "raw", "confidence", F.posexplode(groups).alias("place", "c")).select("network_id", "node_id", "raw", "confidence", "place", "c.*")
    first = F.row_number().over(W.partitionBy("network_id", "node_id", "id").orderBy("place"))
    return flat.withColumn("k", first).filter("k = 1").drop("k")


def topology_corrections(rows: DataFrame, degrees: DataFrame) -> DataFrame:
    """The id that graph structure supports for each node, where another than the raw one scores 0.6 or more.

    degrees (network_id, activity_id, in_degree, out_degree): connected ids gain 0.2, isolated ones lose 0.1, single letters that are no activity lose 0.3."""
    d = degrees.select("network_id", F.col("activity_id").alias("id"), (F.col("in_degree") + F.col("out_degree")).alias("edges"))
    c = topology_candidates(rows).join(d, ["network_id", "id"], "left").filter((F.col("rank") < 2) | F.col("edges").isNotNull())
    known = F.col("edges").isNotNull()
    score = F.col("base") + F.when(known & (F.col("edges") > 0), 0.2).when(known, -0.1).otherwise(0.0) + F.col("confidence") * 0.1 - F.when(~known & (F.length("id") == 1), 0.3).otherwise(0.0)
    best = c.withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 9)).withColumn("k", F.row_number().over(W.partitionBy("network_id", "node_id").orderBy(F.desc("score"), "place"))).filter("k = 1")
    return best.filter((F.col("score") >= 0.6) & (F.col("id") != F.col("raw"))).select("network_id", "node_id", "raw", F.col("id").alias("corrected_id"), "score")
