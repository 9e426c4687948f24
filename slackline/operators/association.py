"""Arrows with the nodes at their two ends, border strokes, and the checks of arrows between events.

Arrows: network_id, segment_id, seq, x1, y1, x2, y2, head_conf, confidence; the head is the second end. Nodes: network_id, node_id,
seq, x, y, width, height, confidence. Every node of a diagram is a candidate, since rays have no end; diagrams hold tens of nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g
from slackline.operators.pairing import SEGMENT, first_end, second_end

#: Distance of contact with a boundary, reach of a ray, widest angle (degrees), least score, and margin that tells two apart.
TOUCH, RAY, WIDEST, LEAST, MARGIN = 15.0, 30.0, 45.0, 0.15, 0.15


def _score(p: g.Point, dx: Column, dy: Column, b: g.Box, forward: bool, shape: Column, arrow: Column) -> Column:
    sign = 1 if forward else -1
    edge = g.boundary_distance(p, b)
    c = g.center(b)
    apart = g.distance(p, c)
    t = g.nearest_hit(p, sign * dx, sign * dy, b)  # the direction is a unit vector: t is a distance
    hit = F.least(F.lit(1.0), F.when(t <= RAY, 1 - t / RAY * 0.3).otherwise(F.greatest(F.lit(0.0), 1 - t / (RAY * 3))) + 0.2)
    boundary = F.when(t.isNotNull(), hit).when(edge <= TOUCH, F.greatest(F.lit(0.0), 1 - edge / TOUCH)).otherwise(0.0)
    end = F.when(edge <= TOUCH, 1 - edge / TOUCH * 0.5).when(edge <= TOUCH * 3, F.greatest(F.lit(0.0), 0.5 - (edge - TOUCH) / (TOUCH * 2) * 0.5)).otherwise(0.0)
    away = F.when(apart >= 1e-6, apart)
    way = F.coalesce((sign * (dx * (c.x - p.x) + dy * (c.y - p.y)) / away + 1) / 2, F.lit(0.5))
    turn = F.pmod(F.abs(F.atan2(c.y - p.y, c.x - p.x) - F.atan2(dy, dx) - (0.0 if forward else math.pi)), F.lit(2 * math.pi))
    turn = F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn)
    wide = math.radians(WIDEST)
    angle = F.when(turn <= wide, 1 - turn / wide * 0.5).otherwise(F.greatest(F.lit(0.0), 0.5 - (turn - wide) / (math.pi - wide) * 0.5))
    tail = 0.10 * angle + 0.05 * shape + 0.05 * arrow
    near = 1 - apart / 30
    return (
        F.when(near > 0.9, 0.90 + 0.10 * way)
        .when(g.contains(b, p, 10.0), 0.35 * 0.8 + 0.25 * boundary + 0.15 * end + 0.05 * way + tail)
        .otherwise(0.35 * boundary + 0.25 * end + 0.20 * way + tail)
    )


def end_scores(arrows: DataFrame, nodes: DataFrame, keep: int = 10) -> DataFrame:
    """The best-scored nodes of each arrow's tail and head: network_id, segment_id, end, node_id, score, rank."""
    n = nodes.select("network_id", *[F.col(c).alias(f"b_{c}") for c in ("node_id", "seq", "x", "y", "width", "height", "confidence")])
    length = g.distance(first_end(), second_end())
    rows = arrows.withColumn("length", length).filter("length >= 1e-6").withColumns({"dx": (F.col("x2") - F.col("x1")) / F.col("length"), "dy": (F.col("y2") - F.col("y1")) / F.col("length")}).join(n, "network_id")
    args = F.col("dx"), F.col("dy"), g.box("b_")
    both = F.array(
        F.struct(F.lit("source").alias("end"), _score(first_end(), *args, False, F.col("b_confidence"), F.col("confidence")).alias("score")),
        F.struct(F.lit("target").alias("end"), _score(second_end(), *args, True, F.col("b_confidence"), F.col("confidence")).alias("score")),
    )
    flat = rows.select(*SEGMENT, "b_node_id", "b_seq", F.explode(both).alias("e")).select(*SEGMENT, "e.end", F.col("b_node_id").alias("node_id"), F.round("e.score", 9).alias("score"), "b_seq").filter(F.col("score") >= LEAST)
    w = W.partitionBy(*SEGMENT, "end").orderBy(F.desc("score"), "b_seq")
    return flat.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).drop("b_seq")


def associated(arrows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Source and target of each arrow with ambiguity flags, or why it has none. When both ends choose one node, the second-best target steps in, else the second-best source."""
    s = end_scores(arrows, nodes).filter("rank <= 2")
    best = s.groupBy(*SEGMENT).agg(*[
        F.max(F.when((F.col("end") == e) & (F.col("rank") == k), F.struct("node_id", "score"))).alias(f"{e}{k}") for e in ("source", "target") for k in (1, 2)
    ])
    rows = arrows.select(*SEGMENT).join(best, SEGMENT, "left")
    s1, s2, t1, t2 = (F.col(f"{e}{k}.node_id") for e in ("source", "target") for k in (1, 2))
    own = s1 == t1
    by_target = F.coalesce(own & (t2 != s1), F.lit(False))
    by_source = F.coalesce(own & ~by_target & (s2 != t1), F.lit(False))
    lost = F.coalesce(own & ~by_target & ~by_source, F.lit(False))
    reason = F.when(s1.isNull(), "no_valid_source").when(t1.isNull(), "no_valid_target").when(lost, "self_association_no_alternative")
    close = lambda e: F.coalesce(F.col(f"{e}1.score") - F.col(f"{e}2.score") < MARGIN, F.lit(False))
    return rows.select(*SEGMENT, F.when(by_source, s2).otherwise(s1).alias("source"), F.when(by_target, t2).otherwise(t1).alias("target"), close("source").alias("source_is_ambiguous"), close("target").alias("target_is_ambiguous"), reason.alias("reason"))


def on_border(p: g.Point, b: g.Box, tolerance: float = 15.0) -> Column:
    """The point lies on one of the box's edges."""
    near = lambda v, edge: F.abs(v - edge) < tolerance
    in_x, in_y = p.x.between(b.x - tolerance, b.x + b.width + tolerance), p.y.between(b.y - tolerance, b.y + b.height + tolerance)
    return ((near(p.x, b.x) | near(p.x, b.x + b.width)) & in_y) | ((near(p.y, b.y) | near(p.y, b.y + b.height)) & in_x)


def border_strokes(segments: DataFrame, shapes: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Segments both of whose ends lie on the border of one shape."""
    from slackline.operators.spatial import near_pairs

    near = near_pairs(segments, shapes.filter("width <> 0 and height <> 0"), "x1", "y1", tolerance * 1.5, ["segment_id"])
    b = g.box("b_")
    return near.filter(on_border(first_end(), b, tolerance) & on_border(second_end(), b, tolerance)).select(*SEGMENT).distinct()


def event_checks(segments: DataFrame, shapes: DataFrame, head: float = 0.20, reach: float = 20.0) -> DataFrame:
    """Why an arrow between events is refused (null: kept): a headless chord of one event, or a headless stroke that touches none.

    Only networks with two circles or more, which make up half of the shapes, are judged; elsewhere every arrow stays."""
    kind = shapes.groupBy("network_id").agg(F.count_if(F.col("shape_type") == "circle").alias("circles"), F.count("*").alias("n"))
    judged = kind.filter((F.col("circles") >= 2) & (F.col("circles") >= 0.5 * F.col("n"))).select("network_id")
    rings = shapes.filter("shape_type = 'circle'").join(judged, "network_id", "left_semi")
    r = rings.select("network_id", "node_id", F.col("seq").alias("ring"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"), ((F.col("width") + F.col("height")) / 4).alias("r"))
    rows = segments.join(r, "network_id")
    c = g.Point(F.col("cx"), F.col("cy"))
    ends = {}
    for name, p in (("a", first_end()), ("b", second_end())):
        far = g.distance(p, c)
        off = F.abs(far - F.col("r"))
        contact = (far < F.col("r")) | (off <= F.least(F.lit(reach), F.greatest(F.lit(4.0), 0.4 * F.col("r"))))
        ends[name] = F.min(F.struct(F.round(off, 9).alias("off"), "ring", "node_id", contact.alias("contact"))).alias(name)
    near = rows.groupBy(*SEGMENT).agg(*ends.values())
    joined = segments.select(*SEGMENT, "head_conf").join(near, SEGMENT, "left")
    headless = F.col("head_conf") < head
    a, b = (F.coalesce(F.col(f"{e}.contact"), F.lit(False)) for e in "ab")
    chord = headless & a & b & (F.col("a.node_id") == F.col("b.node_id"))
    reason = F.when(F.col("a").isNotNull(), F.when(chord, "circle_boundary_same_event_no_arrowhead").when(headless & ~a & ~b, "no_event_contact_no_arrowhead"))
    return joined.select(*SEGMENT, reason.alias("reason"))


def deduplicate_arrows(arrows: DataFrame) -> DataFrame:
    """One arrow of each seed's group: in order, an unused arrow gathers all later unused ones like it, and the most confident stays."""
    rows = arrows.groupBy("network_id").agg(F.expr("array_sort(collect_list(struct(seq, segment_id, x1, y1, x2, y2, confidence, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as n)))").alias("all"))
    far = lambda a, b: f"sqrt(({a[0]} - {b[0]}) * ({a[0]} - {b[0]}) + ({a[1]} - {b[1]}) * ({a[1]} - {b[1]}))"
    ends = lambda v: ((f"{v}.x1", f"{v}.y1"), (f"{v}.x2", f"{v}.y2"))
    nearest = "least(" + ", ".join(far(p, q) for p in ends("s") for q in ends("r")) + ")"
    middle = far(("(s.x1 + s.x2) / 2", "(s.y1 + s.y2) / 2"), ("(r.x1 + r.x2) / 2", "(r.y1 + r.y2) / 2"))
    like = f"(s.n >= 1e-6 and r.n >= 1e-6 and abs(((s.x2 - s.x1) * (r.x2 - r.x1) + (s.y2 - s.y1) * (r.y2 - r.y1)) / (s.n * r.n)) >= 0.7 and {nearest} <= 40 and {middle} <= 50 and least(s.n, r.n) / greatest(s.n, r.n) >= 0.3)"
    like = f"coalesce({like}, false)"
    # an arrow like an earlier seed belongs to the first such seed; others become seeds
    seeds = f"aggregate(all, filter(all, x -> false), (seeds, r) -> if(exists(seeds, s -> {like}), seeds, array_append(seeds, r)))"
    rows = rows.withColumn("seeds", F.expr(seeds))
    flat = rows.select("network_id", F.explode(F.expr(f"transform(all, r -> named_struct('r', r, 'seed', get(filter(seeds, s -> s.seq < r.seq and {like}), 0).seq))")).alias("m"))
    best = flat.groupBy("network_id", F.coalesce("m.seed", "m.r.seq").alias("seed")).agg(F.min(F.struct((-F.col("m.r.confidence")).alias("c"), F.col("m.r.seq").alias("s"), F.col("m.r.segment_id").alias("segment_id"))).alias("b"), F.count("*").alias("pieces"))
    return best.select("network_id", "b.segment_id", "pieces")
