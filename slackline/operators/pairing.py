"""Which two boxes a segment connects: candidates at both ends, pair scores, margins and verdicts; suppression of repeated segments.

Segments: network_id, segment_id, seq, x1, y1, x2, y2, head_conf (0 without arrowhead; its tip is the second end).
Boxes: network_id, node_id, seq, x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g
from slackline.operators import spatial

SEGMENT = ["network_id", "segment_id"]
#: Distance within which a box is near, and one beyond which nearness counts for nothing.
NEAR = 100.0


def first_end() -> g.Point:
    return g.Point(F.col("x1"), F.col("y1"))


def second_end() -> g.Point:
    return g.Point(F.col("x2"), F.col("y2"))


def steps(v: Column, *limits: tuple[float, float], beyond: float) -> Column:
    """The value of the first limit that v is below."""
    out = F.lit(beyond)
    for limit, value in reversed(limits):
        out = F.when(v < limit, value).otherwise(out)
    return out


def contact(p: g.Point, b: g.Box) -> Column:
    return steps(g.outside_distance(p, b), (2, 1.0), (15, 0.9), (30, 0.7), (50, 0.5), (80, 0.3), beyond=0.0)


def closeness(p: g.Point, b: g.Box) -> Column:
    return steps(g.outside_distance(p, b), (5, 1.0), (20, 0.8), (50, 0.5), (NEAR, 0.3), beyond=0.1)


def unit(a: g.Point, b: g.Point) -> tuple[Column, Column, Column]:
    """Length and direction from a to b; null direction for coinciding points."""
    length = g.distance(a, b)
    some = F.when(length >= 1e-6, length)
    return length, (b.x - a.x) / some, (b.y - a.y) / some


def ray_reach(origin: g.Point, other: g.Point, b: g.Box) -> Column:
    _, dx, dy = unit(origin, other)
    t = g.nearest_hit(origin, dx, dy, b)
    return F.when(t.isNull(), 0.0).otherwise(steps(t, (5, 1.0), (30, 0.8), (80, 0.5), beyond=0.3))


def continuity(a: g.Box, b: g.Box) -> Column:
    _, px, py = unit(g.center(a), g.center(b))
    _, sx, sy = unit(first_end(), second_end())
    near = g.clip(1 - (g.outside_distance(first_end(), a) + g.outside_distance(second_end(), b)) / (2 * NEAR), 0.0, 1.0)
    return F.coalesce(F.greatest(F.lit(0.0), sx * px + sy * py) * 0.6 + near * 0.4, F.lit(0.0))


def angle_consistency(a: g.Box, b: g.Box) -> Column:
    """The segment points away from a's centre at its first end and towards b's at its second."""
    _, sx, sy = unit(first_end(), second_end())
    _, ax, ay = unit(first_end(), g.center(a))
    _, bx, by = unit(second_end(), g.center(b))
    at = lambda dot: F.coalesce(F.greatest(F.lit(0.0), dot), F.lit(0.5))
    return F.when(sx.isNull(), 0.0).otherwise((at(F.when(ax.isNotNull(), -(sx * ax + sy * ay))) + at(F.when(bx.isNotNull(), sx * bx + sy * by))) / 2)


def candidate_pairs(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each unordered pair of different boxes once, as the best-ranked ends give it: columns a_* and b_* of the boxes, order (place of generation)."""
    ends = []
    for side, (x, y) in (("a", ("x1", "y1")), ("b", ("x2", "y2"))):
        near = spatial.nearest_nodes(segments, boxes, x, y, ["segment_id"])
        ends.append(near.select(*SEGMENT, F.col("rank").alias(f"{side}_rank"), *[F.col(f"b_{c}").alias(f"{side}_{c}") for c in ("node_id", "x", "y", "width", "height")]))
    pairs = ends[0].join(ends[1], SEGMENT).filter("a_node_id <> b_node_id").withColumn("order", F.col("a_rank") * 10 + F.col("b_rank"))
    key = [*SEGMENT, F.least("a_node_id", "b_node_id"), F.greatest("a_node_id", "b_node_id")]
    first = pairs.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("order"))).filter("k = 1").drop("k", "a_rank", "b_rank")
    return first.join(segments.select(*SEGMENT, "x1", "y1", "x2", "y2", "head_conf"), SEGMENT)


def segment_facts(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Facts of a segment and all boxes of its network: crossed (box ids on the segment), anchored ends, and where a stub points.

    A line may cross any box, so this pairs the segments and boxes of a network, which is one diagram."""
    b = boxes.select("network_id", *[F.col(c).alias(f"b_{c}") for c in ("node_id", "seq", "x", "y", "width", "height")])
    rows = segments.select(*SEGMENT, "x1", "y1", "x2", "y2").join(b, "network_id")
    box = g.box("b_")
    length, dx, dy = unit(first_end(), second_end())
    crosses = F.exists(g.ray_hits(first_end(), dx, dy, box), lambda h: (h["t"] > 0) & (h["t"] < length))
    ahead = g.slab_distance(second_end(), dx, dy, box, 4.0)
    holds = g.contains(box, first_end()) & g.contains(box, second_end())
    facts = rows.groupBy(*SEGMENT).agg(
        F.collect_list(F.when(crosses, F.col("b_node_id"))).alias("crossed"),
        F.min(g.outside_distance(first_end(), box)).alias("gap1"), F.min(g.outside_distance(second_end(), box)).alias("gap2"),
        F.min(F.when(g.contains(box, second_end()), F.struct("b_seq", "b_node_id", holds.alias("holds")))).alias("inside"),
        F.max(holds).alias("in_one_box"),
        F.array_sort(F.collect_list(F.when(ahead.isNotNull(), F.struct(ahead.alias("t"), "b_seq", "b_node_id")))).alias("ahead"),
    )
    first = F.try_element_at(F.filter("ahead", lambda h: h["b_node_id"] != F.col("inside.b_node_id")), F.lit(1))["b_node_id"]
    return facts.withColumn("points_at", first)


def scored_pairs(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Candidate pairs with their score (0 to 1)."""
    rows = candidate_pairs(segments, boxes).join(segment_facts(segments, boxes), SEGMENT)
    a, b = g.box("a_"), g.box("b_")
    other = F.size(F.filter("crossed", lambda n: (n != F.col("a_node_id")) & (n != F.col("b_node_id"))))
    crossing = F.least(F.lit(1.0), other * 0.3)
    floating = F.when((F.col("head_conf") <= 0) & (F.col("gap1") > 12) & (F.col("gap2") > 12), 1.0).otherwise(0.0)
    nearby = steps(g.distance(g.center(a), g.center(b)), (100, 0.8), (300, 0.6), (600, 0.4), beyond=0.2)
    raw = (
        0.22 * contact(first_end(), a) + 0.22 * contact(second_end(), b) + 0.12 * closeness(first_end(), a) + 0.12 * closeness(second_end(), b) + 0.08 * ray_reach(first_end(), second_end(), a) + 0.08 * ray_reach(second_end(), first_end(), b)
        + 0.10 * continuity(a, b) + 0.06 * angle_consistency(a, b) - 0.15 * crossing + 0.03 * nearby - 0.25 * floating
    )
    length = g.distance(first_end(), second_end())
    short = F.when(length < 10, 0.3).when(length < 20, 0.6).otherwise(1.0)
    stub = (F.col("head_conf") > 0) & F.coalesce(F.col("inside.holds"), F.lit(False)) & ~F.coalesce(F.col("points_at").isin(F.col("a_node_id"), F.col("b_node_id")), F.lit(False))
    return rows.withColumn("length", length).withColumn("score", F.round(g.clip(raw * short, 0.0, 1.0), 9)).withColumn("floating", floating > 0).withColumn("stub", stub)


def resolved_pairs(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """The best pair of each segment with its margin and verdict; segments without any pair have no row."""
    order = W.partitionBy(*SEGMENT).orderBy(F.desc("score"), "order")
    rows = scored_pairs(segments, boxes).withColumn("rank", F.row_number().over(order)).withColumn("margin", F.round(F.col("score") - F.lead("score").over(order), 9)).filter("rank = 1")
    s, m = F.col("score"), F.col("margin")
    status = F.when(s < 0.1, "REJECTED").when(F.coalesce(m < 0.15, F.lit(False)), "REVIEW_REQUIRED").when(s >= 0.5, "CONFIRMED").otherwise("CONTEXTUALLY_RESOLVED")
    doubtful = (F.col("head_conf") > 0) & (F.col("head_conf") < 0.3) & (F.col("length") >= 100) & (s < 0.8) & F.coalesce(m < 0.25, F.lit(False))
    review = F.col("floating") | (F.col("stub") & F.col("in_one_box")) | doubtful
    return rows.select(*SEGMENT, F.col("a_node_id").alias("node_a"), F.col("b_node_id").alias("node_b"), "score", "margin", F.when((status != "REJECTED") & review, "REVIEW_REQUIRED").otherwise(status).alias("status"))


def arrow_confidence(line: Column, length: Column, head: Column) -> Column:
    """Confidence of an arrow from its line, length and arrowhead."""
    reach = F.least(F.lit(1.0), length / 150)
    return F.when(head > 0, F.least(F.lit(1.0), 0.2 * line + 0.4 * head + 0.2 * reach + 0.2)).otherwise(0.15 * line + 0.1 * reach)


def suppress_segments(segments: DataFrame, angle: float = 8.0, lateral: float = 6.0, overlap: float = 0.5) -> DataFrame:
    """Segments (with confidence) that stay when repeats of one shaft merge: in order of seq, a more confident repeat takes its parent's place.

    Angles are compared modulo 180 without wrapping around, and a is the kept segment, whose direction measures."""
    fields = "seq, segment_id, x1, y1, x2, y2, confidence, degrees(atan2(y2 - y1, x2 - x1)) as angle"
    rows = segments.groupBy("network_id").agg(F.expr(f"array_sort(collect_list(struct({fields})))").alias("all"))
    length = "sqrt((k.x2 - k.x1) * (k.x2 - k.x1) + (k.y2 - k.y1) * (k.y2 - k.y1))"
    ux, uy = f"((k.x2 - k.x1) / {length})", f"((k.y2 - k.y1) / {length})"
    side = lambda x, y: f"abs((s.{x} - k.x1) * {uy} - (s.{y} - k.y1) * {ux})"
    along = lambda x, y: f"((s.{x} - k.x1) * {ux} + (s.{y} - k.y1) * {uy})"
    low, high = f"least({along('x1', 'y1')}, {along('x2', 'y2')})", f"greatest({along('x1', 'y1')}, {along('x2', 'y2')})"
    shared = f"(least({length}, {high}) - greatest(0D, {low}))"
    same = (
        f"(abs(pmod(k.angle, 180D) - pmod(s.angle, 180D)) <= {angle} and {length} >= 1e-6 and greatest({side('x1', 'y1')}, {side('x2', 'y2')}) <= {lateral}"
        f" and {shared} >= 0 and least({length}, {high} - {low}) > 1e-6 and {shared} / least({length}, {high} - {low}) >= {overlap})"
    )
    # the first kept segment that s repeats
    parent = f"array_position(transform(kept, k -> coalesce({same}, false)), true)"
    step = f"transform(array({parent}), p -> if(p = 0, array_append(kept, s), if(s.confidence > kept[cast(p as int) - 1].confidence, array_append(filter(kept, (k, i) -> i <> p - 1), s), kept)))[0]"
    return rows.select("network_id", F.explode(F.expr(f"aggregate(all, filter(all, x -> false), (kept, s) -> {step})")).alias("s")).select("network_id", "s.segment_id", "s.confidence")


def suppress_texts(regions: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Text regions that stay: by confidence, one that repeats a kept text exactly, or overlaps a kept one of equal lower-case text, goes."""
    rows = regions.groupBy("network_id").agg(F.expr("array_sort(collect_list(struct(-confidence as rank, seq, region_id, text, x, y, width, height)))").alias("all"))
    both = "(greatest(0D, least(k.x + k.width, r.x + r.width) - greatest(k.x, r.x)) * greatest(0D, least(k.y + k.height, r.y + r.height) - greatest(k.y, r.y)))"
    iou = f"{both} / greatest(k.width * k.height + r.width * r.height - {both}, 1D)"
    kept = f"aggregate(all, filter(all, x -> false), (kept, r) -> if(exists(kept, k -> k.text = r.text or (lower(k.text) = lower(r.text) and {iou} > {least_iou})), kept, array_append(kept, r)))"
    return rows.select("network_id", F.explode(F.expr(kept)).alias("r")).select("network_id", "r.region_id", "r.text")


def merge_segments(segments: DataFrame, angle: float = 15.0, reach: float = 20.0, cosine: float = 0.85) -> DataFrame:
    """Collinear pieces joined transitively: network_id, segment_id (of the first piece), ends of the hull along the first piece, confidence, pieces.

    Two pieces join when their angles (0 to 360) differ by at most ``angle``, ends lie within ``reach`` and the absolute cosine is at least ``cosine``.
    Candidate pairs meet by grid cells of their ends."""
    from slackline.operators import graph

    s = segments.withColumn("angle", F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(360.0)))
    ends = s.select("network_id", "segment_id", "angle", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e"))
    ends = ends.select("network_id", "segment_id", "angle", "e.*").withColumn("width", F.lit(0.0)).withColumn("height", F.lit(0.0))
    close = spatial.near_pairs(ends, ends, "x", "y", reach, ["segment_id"]).filter("segment_id < b_segment_id")
    turn = F.abs(F.col("angle") - F.col("b_angle"))
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)
    links = close.filter((turn <= angle) & (F.abs(F.cos(F.radians(F.col("angle") - F.col("b_angle")))) >= cosine)).select("network_id", F.col("segment_id").alias("source"), F.col("b_segment_id").alias("target")).distinct()
    groups = graph.components(s.select("network_id", F.col("segment_id").alias("activity_id")), links).withColumnRenamed("activity_id", "segment_id")
    rows = s.join(groups, SEGMENT)
    first = rows.groupBy("network_id", "component").agg(F.min(F.struct("seq", "segment_id", "x1", "y1", "x2", "y2")).alias("r"), F.max("confidence").alias("best"), F.count("*").alias("pieces"))
    ref1, ref2 = g.Point(F.col("r.x1"), F.col("r.y1")), g.Point(F.col("r.x2"), F.col("r.y2"))
    length, ux, uy = unit(ref1, ref2)
    points = rows.select("network_id", "component", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).join(first, ["network_id", "component"])
    along = (F.col("p.x") - ref1.x) * ux + (F.col("p.y") - ref1.y) * uy
    hull = points.withColumn("along", along).groupBy("network_id", "component").agg(F.min_by("p", "along").alias("a"), F.max_by("p", "along").alias("b"))
    out = first.join(hull, ["network_id", "component"])
    return out.select("network_id", F.col("r.segment_id").alias("segment_id"), F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), F.col("best").alias("confidence"), "pieces")
