"""Networks, boxes, segments, texts and decisions derived from the driver's tables.

An order is a network, its line items are activities with the quantity as duration; the edge
rules go from lower to higher place, so every clean network is acyclic. Vectors give boxes,
segments and text regions; events give review decisions. The same rules stand in
derived_sql.py for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network_id, activity_id, seq, duration, optimistic_time, most_likely_time, pessimistic_time."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order))
    q = F.col("l_quantity")
    return rows.select(
        F.col("l_orderkey").alias("network_id"),
        F.concat(F.lit("N"), F.lpad(F.col("seq").cast("string"), 2, "0")).alias("activity_id"),
        "seq",
        q.alias("duration"),
        (q * 0.5).alias("optimistic_time"),
        q.alias("most_likely_time"),
        (q * (2 + F.col("l_tax"))).alias("pessimistic_time"),
    )


def dependencies(acts: DataFrame) -> DataFrame:
    """network_id, source, target by the edge rules i -> i+1 (i % 3 <> 0), i -> i+2, i -> i+3 (i even)."""
    sized = acts.withColumn("n", F.max("seq").over(W.partitionBy("network_id")))
    ahead = F.filter(
        F.array(F.when(F.col("seq") % 3 != 0, F.col("seq") + 1), F.col("seq") + 2, F.when(F.col("seq") % 2 == 0, F.col("seq") + 3)),
        lambda t: t.isNotNull() & (t <= F.col("n")),
    )
    edges = sized.select("network_id", F.col("activity_id").alias("source"), F.explode(ahead).alias("t"))
    return edges.select("network_id", "source", F.concat(F.lit("N"), F.lpad(F.col("t").cast("string"), 2, "0")).alias("target"))


def dirty_activities(acts: DataFrame) -> DataFrame:
    """Durations missing in every 89th network, an empty id in every 71st."""
    bad = (F.col("network_id") % 89 == 0) & (F.col("seq") == 1)
    blank = (F.col("network_id") % 71 == 0) & (F.col("seq") == 2)
    return acts.withColumn("duration", F.when(~bad, F.col("duration"))).withColumn("activity_id", F.when(blank, "").otherwise(F.col("activity_id")))


def dirty_dependencies(deps: DataFrame) -> DataFrame:
    """A back edge in every 97th network, an unknown target in every 83rd, a self loop in every 79th, a repeated edge in every 73rd."""
    k = F.col("network_id")
    first = deps.filter("source = 'N01'").dropDuplicates(["network_id"]).select("network_id")
    back = deps.filter((k % 97 == 0) & (F.col("source") == "N01")).select("network_id", F.col("target").alias("source"), F.col("source").alias("target"))
    unknown = first.filter(k % 83 == 0).select("network_id", F.lit("N01").alias("source"), F.lit("X99").alias("target"))
    loop = first.filter(k % 79 == 0).select("network_id", F.lit("N01").alias("source"), F.lit("N01").alias("target"))
    again = deps.filter((k % 73 == 0) & (F.col("source") == "N01"))
    return deps.unionByName(back).unionByName(unknown).unionByName(loop).unionByName(again)


def component(k: int):
    return F.element_at("embedding", k).cast("double")


def diagram_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network_id, node_id, seq, shape_type, x, y, width, height, confidence: 25 boxes a network."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(
        F.expr("vec_id div 25").alias("network_id"),
        F.concat(F.lit("B"), F.lpad((F.col("vec_id") % 25).cast("string"), 2, "0")).alias("node_id"),
        (F.col("vec_id") % 25).cast("int").alias("seq"),
        F.when(F.col("label") % 3 == 0, "circle").when(F.col("label") % 3 == 1, "rectangle").otherwise("polygon").alias("shape_type"),
        F.round(500 + 1500 * component(1), 3).alias("x"),
        F.round(400 + 1200 * component(2), 3).alias("y"),
        F.round(60 + 200 * F.abs(component(3)), 3).alias("width"),
        F.round(40 + 150 * F.abs(component(4)), 3).alias("height"),
        F.round(0.3 + F.abs(component(5)), 4).alias("confidence"),
    )


def diagram_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network_id, segment_id, seq, x1, y1, x2, y2, head_conf, confidence."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(
        F.expr("vec_id div 25").alias("network_id"),
        F.concat(F.lit("S"), F.lpad((F.col("vec_id") % 25).cast("string"), 2, "0")).alias("segment_id"),
        (F.col("vec_id") % 25).cast("int").alias("seq"),
        F.round(500 + 1500 * component(6), 3).alias("x1"),
        F.round(400 + 1200 * component(7), 3).alias("y1"),
        F.round(500 + 1500 * component(8), 3).alias("x2"),
        F.round(400 + 1200 * component(9), 3).alias("y2"),
        F.round(F.greatest(F.lit(0.0), 4 * component(10)), 4).alias("head_conf"),
        F.round(0.3 + F.abs(component(11)), 4).alias("confidence"),
    )


def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network_id, region_id, seq, text, x, y, width, height, confidence."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(
        F.expr("vec_id div 25").alias("network_id"),
        F.concat(F.lit("T"), F.lpad((F.col("vec_id") % 25).cast("string"), 2, "0")).alias("region_id"),
        (F.col("vec_id") % 25).cast("int").alias("seq"),
        F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("A"), (F.col("vec_id") % 7).cast("string"))).otherwise((F.col("vec_id") % 11).cast("string")).alias("text"),
        F.round(500 + 1500 * component(12), 3).alias("x"),
        F.round(400 + 1200 * component(13), 3).alias("y"),
        F.round(20 + 60 * F.abs(component(14)), 3).alias("width"),
        F.round(10 + 30 * F.abs(component(15)), 3).alias("height"),
        F.round(0.3 + F.abs(component(16)), 4).alias("confidence"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions: seq, item_id, decision, ts, corrected_value."""
    rows = read(spark, sf_dir, "events")
    kind = F.pmod(F.col("event_id"), F.lit(5))
    return rows.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("I"), F.col("user_id").cast("string")).alias("item_id"),
        F.when(kind == 0, "ACCEPT").when(kind == 1, "CORRECT").when(kind == 2, "REJECT").when(kind == 3, "LEAVE_UNRESOLVED").otherwise("COMMENT").alias("decision"),
        "ts",
        F.when(kind == 1, F.round("value", 2)).alias("corrected_value"),
    )
