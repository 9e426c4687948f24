"""Networks from shapes, texts and arrows, and their reconciliation.

Texts reach a shape as scored associations; ids, durations and labels are read from them by precedence. Rectangles become
activities, circles events; arrows between events become activities on arrows, whose precedence follows from shared events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import text


def shape_texts(associations: DataFrame, regions: DataFrame) -> DataFrame:
    """network_id, node_id, id_text, number, label from associations (network_id, region_id, target_id, score), visited from the best score down.

    A later id or number replaces an earlier one, the first label stays."""
    rows = associations.join(regions.select("network_id", "region_id", "text"), ["network_id", "region_id"]).withColumn("kind", text.text_type(F.col("text")))
    order = F.struct((-F.round("score", 9)).alias("r"), "region_id")
    pick = lambda kind, best: best(F.when(F.col("kind") == kind, F.struct(order.alias("o"), F.col("text").alias("t"))))
    out = rows.groupBy("network_id", F.col("target_id").alias("node_id")).agg(pick("activity_id", F.max).alias("i"), pick("numeric", F.max).alias("n"), pick("text_label", F.min).alias("l"))
    return out.select("network_id", "node_id", text.extracted_id(F.col("i.t")).alias("id_text"), text.first_number(F.regexp_replace("n.t", ",", "")).alias("number"), F.col("l.t").alias("label"))


def activities(shapes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rectangles as activities: activity_id from text, else INFERRED_nnn by spatial order (counted over all rectangles); repeats get _1, _2, ...; geometric id kept."""
    order = W.partitionBy("network_id").orderBy(F.bround(F.col("y") / 40), "x", "seq")
    rows = shapes.filter("shape_type = 'rectangle'").withColumn("place", F.row_number().over(order)).join(texts, ["network_id", "node_id"], "left")
    name = F.coalesce("id_text", F.concat(F.lit("INFERRED_"), F.lpad(F.col("place").cast("string"), 3, "0")))
    rows = rows.withColumn("id", name).withColumn("k", F.row_number().over(W.partitionBy("network_id", "id").orderBy("place")) - 1)
    return rows.select("network_id", "node_id", F.when(F.col("k") == 0, F.col("id")).otherwise(F.concat_ws("_", "id", "k")).alias("activity_id"), F.col("place").alias("seq"), F.coalesce("number", F.lit(0.0)).alias("duration"), F.col("id_text").isNull().alias("is_inferred"))


def dependencies(validated: DataFrame, activities: DataFrame) -> DataFrame:
    """Accepted node dependencies as activity dependencies; ends that are no activity and self loops go."""
    ids = activities.select("network_id", "node_id", "activity_id")
    rows = validated.filter("level = 'HIGH' and not is_duplicate")
    for end in ("source", "target"):
        rows = rows.join(ids.select("network_id", F.col("node_id").alias(end), F.col("activity_id").alias(f"{end}_id")), ["network_id", end])
    return rows.filter("source_id <> target_id").select("network_id", F.col("source_id").alias("source"), F.col("target_id").alias("target")).distinct()


def reconciled_ids(activities: DataFrame) -> DataFrame:
    """status of each activity's id: holders of one id all need review, except where it is theirs alone."""
    n = F.count("*").over(W.partitionBy("network_id", "activity_id"))
    return activities.withColumn("status", F.when(F.col("activity_id").startswith("INFERRED_") | (n > 1), "REVIEW_REQUIRED").otherwise("CONFIRMED"))


def review_items(activities: DataFrame) -> DataFrame:
    """network_id, item_id, item_type, reason: what a person has to decide before the network can be built."""
    kinds = F.array(
        F.when(F.col("is_inferred"), F.struct(F.lit("activity").alias("item_type"), F.lit("inferred_id").alias("reason"))),
        F.when(F.col("duration") <= 0, F.struct(F.lit("duration").alias("item_type"), F.lit("no_duration").alias("reason"))),
    )
    flat = activities.select("network_id", F.col("node_id").alias("item_id"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return flat.select("network_id", "item_id", "k.item_type", "k.reason")


def event_network(arrows: DataFrame) -> DataFrame:
    """Activities on arrows (network_id, activity_id, from_event, to_event, seq) as edges between events; of parallel arrows the last stays."""
    return arrows.groupBy("network_id", "from_event", "to_event").agg(F.max_by("activity_id", "seq").alias("activity_id"), F.count("*").alias("parallel"))
