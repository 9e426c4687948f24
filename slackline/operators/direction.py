"""Which way a segment points between two given boxes: both orientations are scored, the margin decides.

Segments: network_id, segment_id, seq, x1, y1, x2, y2, head_conf; an arrowhead's tip is the second end. Ends are first put in
geometric order (by x, then y), so the order in which they were detected says nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g
from slackline.operators.pairing import SEGMENT, resolved_pairs, steps

#: Distance beyond which an end is far from a box; widest angle to the target; margin that confirms a direction.
FAR, WIDEST, MARGIN = 80.0, 40.0, 0.20
#: Scores from which a dependency is accepted, and from which it is reviewed.
HIGH, MEDIUM = 0.55, 0.35


def in_geometric_order(segments: DataFrame) -> DataFrame:
    """Ends by x, then y; tip_x and tip_y hold the arrowhead's place, null without one."""
    swap = g.endpoint_swap(g.Point(F.col("x1"), F.col("y1")), g.Point(F.col("x2"), F.col("y2")))
    tip = F.col("head_conf") > 0
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return segments.withColumns({"tip_x": F.when(tip, F.col("x2")), "tip_y": F.when(tip, F.col("y2")), "x1": pick("x1", "x2"), "y1": pick("y1", "y2"), "x2": pick("x2", "x1"), "y2": pick("y2", "y1")})


def touch(side: Column | str, distance: Column, nx: Column, ny: Column, confidence: Column) -> Column:
    side = F.lit(side) if isinstance(side, str) else side
    return F.struct(side.alias("side"), distance.cast("double").alias("distance"), nx.cast("double").alias("nx"), ny.cast("double").alias("ny"), confidence.cast("double").alias("confidence"))


def contact(p: g.Point, b: g.Box) -> Column:
    """Side of a box that a point touches: far, inside, corner or an edge, with outward normal and confidence."""
    far, c = g.outside_distance(p, b), g.center(b)
    left, right, top, bottom = F.abs(p.x - b.x), F.abs(p.x - b.x - b.width), F.abs(p.y - b.y), F.abs(p.y - b.y - b.height)
    across, down, corner = F.least(left, right), F.least(top, bottom), F.least(b.width, b.height) * 0.2
    rx, ry = (F.coalesce((v - low) / F.nullif(size, F.lit(0.0)), F.lit(0.5)) for v, low, size in ((p.x, b.x, b.width), (p.y, b.y, b.height)))
    zero = F.lit(0.0)
    sure = F.greatest(zero, 1 - far / FAR)
    flat = across < down
    edge = F.when(flat, F.when(left < right, "left").otherwise("right")).otherwise(F.when(top < bottom, "top").otherwise("bottom"))
    nx = F.when(flat, F.when(left < right, -1.0).otherwise(1.0)).otherwise(0.0)
    ny = F.when(flat, 0.0).otherwise(F.when(top < bottom, -1.0).otherwise(1.0))
    cx, cy = F.when(p.x < c.x, -0.707).otherwise(0.707), F.when(p.y < c.y, -0.707).otherwise(0.707)
    return (
        F.when(far > FAR, touch("far", far, zero, zero, zero))
        .when(rx.between(0.05, 0.95) & ry.between(0.05, 0.95), touch("inside", far, zero, zero, F.lit(0.3)))
        .when((across < corner) & (down < corner), touch("corner", far, cx, cy, F.greatest(zero, 1 - far / 30)))
        .otherwise(touch(edge, far, nx, ny, sure))
    )


def projected(p: g.Point, dx: Column, dy: Column, b: g.Box) -> Column:
    """Contact where the ray from p first meets the box's boundary; null when it does not."""
    hits = F.transform(g.ray_hits(p, dx, dy, b), lambda h: F.struct(h["t"], F.array_position(F.array(*map(F.lit, ("left", "right", "top", "bottom"))), h["edge"]).alias("i"), h["edge"]))
    edge = F.array_min(hits)["edge"]
    nx = F.when(edge == "left", -1.0).when(edge == "right", 1.0).otherwise(0.0)
    ny = F.when(edge == "top", -1.0).when(edge == "bottom", 1.0).otherwise(0.0)
    return F.when(edge.isNotNull(), touch(edge, F.lit(0.0), nx, ny, F.lit(0.7)))


def angle_score(a: Column, b: Column) -> Column:
    """1 for equal angles (radians), 0.5 at the widest that counts, 0 beyond."""
    import math

    turn = F.pmod(F.abs(a - b), F.lit(2 * math.pi))
    turn = F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn)
    return F.when(turn > math.radians(WIDEST), 0.0).otherwise(1 - turn / math.radians(WIDEST) * 0.5)


def positive(v: Column) -> Column:
    return F.greatest(F.lit(0.0), v)


def leaning(dot: Column) -> Column:
    return F.when(dot > 0, F.least(F.lit(1.0), dot * 1.5)).otherwise(0.0)


def way(a: g.Point, b: g.Point) -> tuple[Column, Column, Column]:
    """Distance and direction from a to b; direction (0, 0) for coinciding points."""
    n = g.distance(a, b)
    safe = F.when(n > 1e-6, n)
    return n, F.coalesce((b.x - a.x) / safe, F.lit(0.0)), F.coalesce((b.y - a.y) / safe, F.lit(0.0))


def orientations(pairs: DataFrame, segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Both orientations of each pair (network_id, segment_id, node_a, node_b): source, target, forward (a to b) and score."""
    s = segments.select(*SEGMENT, "x1", "y1", "x2", "y2", "tip_x", "tip_y", "head_conf")
    p1, p2 = g.Point(F.col("x1"), F.col("y1")), g.Point(F.col("x2"), F.col("y2"))
    length, ax, ay = way(p1, p2)
    # boxes that the line's two rays meet; a line may meet any box of its diagram
    b = boxes.select("network_id", *[F.col(c).alias(f"b_{c}") for c in ("node_id", "x", "y", "width", "height")])
    ahead = F.exists(g.ray_hits(p1, ax, ay, g.box("b_")), lambda h: h["t"] > 0)
    behind = F.exists(g.ray_hits(p2, -ax, -ay, g.box("b_")), lambda h: h["t"] > 0)
    met = s.join(b, "network_id").groupBy(*SEGMENT).agg(F.collect_list(F.when(ahead, F.col("b_node_id"))).alias("ahead"), F.collect_list(F.when(behind, F.col("b_node_id"))).alias("behind"))
    both = pairs.select(*SEGMENT, F.explode(F.array(F.struct(F.col("node_a").alias("source"), F.col("node_b").alias("target"), F.lit(True).alias("forward")), F.struct(F.col("node_b").alias("source"), F.col("node_a").alias("target"), F.lit(False).alias("forward")))).alias("o")).select(*SEGMENT, "o.*")
    side = lambda prefix, key: boxes.select("network_id", F.col("node_id").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in g.Box._fields])
    rows = both.join(side("s_", "source"), ["network_id", "source"]).join(side("t_", "target"), ["network_id", "target"]).join(s, SEGMENT).join(met, SEGMENT)
    sb, tb = g.box("s_"), g.box("t_")
    forward = F.col("forward")
    sp = g.Point(F.when(forward, p1.x).otherwise(p2.x), F.when(forward, p1.y).otherwise(p2.y))
    tp = g.Point(F.when(forward, p2.x).otherwise(p1.x), F.when(forward, p2.y).otherwise(p1.y))
    rows = rows.withColumns({"ax": ax, "ay": ay, "length": length, "ox": F.when(forward, ax).otherwise(-ax), "oy": F.when(forward, ay).otherwise(-ay)})
    ax, ay, ox, oy = (F.col(c) for c in ("ax", "ay", "ox", "oy"))

    # independent evidence: contacts of whichever end is nearer, moved to the boundary along the axis
    rows = rows.withColumns({"c1": contact(p1, sb), "c2": contact(p2, tb), "d1": contact(p1, tb), "d2": contact(p2, sb)})
    swap = F.col("d1.distance") + F.col("d2.distance") < F.col("c1.distance") + F.col("c2.distance")
    rows = rows.withColumns({"sc": F.when(swap, F.col("d2")).otherwise(F.col("c1")), "tc": F.when(swap, F.col("d1")).otherwise(F.col("c2"))})

    def moved(rows: DataFrame, name: str, cond: Column, to: Column) -> DataFrame:
        return rows.withColumn(name, F.when(cond, F.coalesce(to, F.col(name))).otherwise(F.col(name)))

    rows = moved(rows, "sc", F.col("sc.side") == "inside", projected(p1, ax, ay, sb))
    rows = moved(rows, "tc", F.col("tc.side") == "inside", projected(p2, -ax, -ay, tb))
    rows = moved(rows, "tc", (F.col("tc.side") == "far") | (F.col("tc.distance") > FAR * 0.5), projected(p2, ax, ay, tb))
    rows = moved(rows, "sc", (F.col("sc.side") == "far") | (F.col("sc.distance") > FAR * 0.5), projected(p1, -ax, -ay, sb))
    dot = lambda c: F.col(f"{c}.nx") * ax + F.col(f"{c}.ny") * ay
    sure = lambda c: F.col(f"{c}.confidence")
    is_far = (F.col("sc.side") == "far") | (F.col("tc.side") == "far")
    loose = lambda c: F.col(f"{c}.side").isin("far", "inside")
    near = lambda box: positive(1 - F.least(g.outside_distance(p1, box), g.outside_distance(p2, box)) / FAR)
    rows = rows.withColumns({
        "normals": F.when(is_far, 0.0).otherwise((positive(dot("sc")) * sure("sc") + positive(-dot("tc")) * sure("tc")) / 2),
        "exits": F.when(loose("sc"), 0.0).otherwise(leaning(dot("sc")) * sure("sc")),
        "enters": F.when(loose("tc"), 0.0).otherwise(leaning(-dot("tc")) * sure("tc")),
        "joined": F.when(is_far, 0.0).otherwise((near(sb) * sure("sc") + near(tb) * sure("tc")) / 2),
    })
    opposite = lambda a, b, cond: (F.col("sc.side") == a) & (F.col("tc.side") == b) & cond
    bonus = F.when(opposite("right", "left", ax < 0) | opposite("left", "right", ax > 0) | opposite("bottom", "top", ay < 0) | opposite("top", "bottom", ay > 0), 0.3).otherwise(0.0)
    path = F.when(is_far, 0.0).otherwise(F.least(F.lit(1.0), (F.col("exits") + F.col("enters")) / 2 + bonus))
    cs, ct = g.center(sb), g.center(tb)
    angle = angle_score(F.atan2(ct.y - cs.y, ct.x - cs.x), F.atan2(ay, ax))
    others = lambda met: F.least(F.lit(1.0), F.size(F.filter(met, lambda n: n != F.col("target"))) * 0.3)
    head = F.col("head_conf")
    at_tip = F.coalesce(steps(g.outside_distance(g.Point(F.col("tip_x"), F.col("tip_y")), tb), (10, 1.0), (30, 0.7), (60, 0.4), beyond=0.1) * head, F.lit(0.0))
    boundary = lambda e, n, p, c: e * (F.col("exits") + F.col("enters")) + n * F.col("normals") + p * path + c * F.col("joined") + 0.05 * angle - 0.10 * others(F.col("ahead"))
    rows = rows.withColumn("independent", g.clip(F.when(head > 0.3, 0.30 * at_tip + boundary(0.15, 0.15, 0.10, 0.10)).otherwise(boundary(0.25, 0.20, 0.15, 0.10)), 0.0, 1.0))

    # the orientation's own factors
    rows = rows.withColumns({"os": contact(sp, sb), "ot": contact(tp, tb)})
    rows = moved(rows, "os", F.col("os.side") == "inside", projected(sp, ox, oy, sb))
    rows = moved(rows, "ot", F.col("ot.side") == "inside", projected(tp, -ox, -oy, tb))

    def boundary_contact(p: g.Point, box: g.Box, c: str) -> Column:
        own = steps(g.outside_distance(p, box), (2, 0.0), (FAR * 0.3, 0.7), (FAR * 0.6, 0.4), (FAR, 0.2), beyond=0.0)
        own = F.when(g.outside_distance(p, box) < 2, F.when(g.contains(box, p), 0.8).otherwise(0.95)).otherwise(own)
        return F.when((sure(c) > 0.5) & ~loose(c), F.greatest(own, sure(c) * 0.8)).otherwise(own)

    def normal(p: g.Point, box: g.Box, c: str, sign: int) -> Column:
        n, ux, uy = way(g.center(box), p)
        own = F.when(n < 1e-6, 0.0).otherwise(leaning(sign * (ux * ox + uy * oy)))
        lean = sign * (F.col(f"{c}.nx") * ox + F.col(f"{c}.ny") * oy)
        usable = (sure(c) > 0.5) & ((F.col(f"{c}.nx") != 0) | (F.col(f"{c}.ny") != 0)) & (lean > 0)
        return F.when(usable, F.greatest(own, leaning(lean) * sure(c))).otherwise(own)

    apart, cx, cy = way(cs, ct)
    along = cx * ox + cy * oy
    flow = F.when(apart < 1e-6, 0.0).when(along > 0.5, 0.6 + 0.4 * along).when(along > 0, 0.3 * along).otherwise(0.0)
    ratio = F.col("length") / F.nullif(apart, F.lit(0.0))
    fits = F.when(apart < 1e-6, 0.0).when((ratio > 0.5) & (ratio < 2), 0.8).when((ratio > 0.3) & (ratio < 3), 0.5).otherwise(0.2)
    has_tip = F.col("tip_x").isNotNull()
    own = (
        0.18 * F.when(has_tip, at_tip).otherwise(0.3)
        + 0.15 * boundary_contact(sp, sb, "os") + 0.15 * boundary_contact(tp, tb, "ot") + 0.12 * normal(sp, sb, "os", 1) + 0.12 * normal(tp, tb, "ot", -1)
        + F.when(has_tip, 0.10).otherwise(0.02) * positive(along)
        + 0.07 * angle_score(F.atan2(ct.y - sp.y, ct.x - sp.x), F.atan2(oy, ox))
        + 0.10 * flow + F.when(has_tip, 0.05).otherwise(0.01) * positive(ax * cx + ay * cy) + 0.03 * fits
        - 0.13 * F.when(forward, others(F.col("ahead"))).otherwise(others(F.col("behind")))
    )
    weight = F.when(has_tip, 0.15).otherwise(0.35)
    score = g.clip(weight * F.col("independent") + (1 - weight) * own, 0.0, 1.0)
    return rows.select(*SEGMENT, "source", "target", "forward", F.round(score, 9).alias("score"), F.round("independent", 9).alias("independent"), "length", has_tip.alias("has_tip"))


def resolved_directions(pairs: DataFrame, segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """The better orientation of each pair (b to a on ties) with margin and verdict."""
    order = W.partitionBy(*SEGMENT).orderBy(F.desc("score"), "forward")
    rows = orientations(pairs, segments, boxes).withColumn("k", F.row_number().over(order)).withColumn("margin", F.round(F.col("score") - F.lead("score").over(order), 9)).filter("k = 1")
    s, m = F.col("score"), F.col("margin")
    lost = ~F.col("has_tip") & (F.col("length") >= 150) & (m < MARGIN)
    status = F.when(lost, "REVIEW_REQUIRED").when((m >= MARGIN) & (s >= 0.5), "CONFIRMED").when(s >= 0.3, "CONTEXTUALLY_RESOLVED").when(s >= 0.1, "REVIEW_REQUIRED").otherwise("REJECTED")
    return rows.select(*SEGMENT, "source", "target", "score", "margin", status.alias("status"))


def validated_dependencies(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Segments as dependencies: the pair's and the direction's scores weigh the same; accepted edges count once, in order of seq.

    level: HIGH (accepted), MEDIUM (review), LOW or REJECTED; is_duplicate marks repeats of an accepted edge."""
    ordered = in_geometric_order(segments)
    pairs = resolved_pairs(ordered, boxes)
    ways = resolved_directions(pairs.filter("status <> 'REJECTED'"), ordered, boxes).select(*SEGMENT, "source", "target", F.col("score").alias("way_score"), F.col("status").alias("way_status"))
    rows = pairs.join(ways, SEGMENT, "left").join(segments.select(*SEGMENT, "seq"), SEGMENT)
    score = 0.5 * F.col("score") + 0.5 * F.col("way_score")
    refused = (F.col("status") == "REJECTED") | (F.col("way_status") == "REJECTED")
    review = (F.col("status") == "REVIEW_REQUIRED") | (F.col("way_status") == "REVIEW_REQUIRED")
    level = F.when(refused, "REJECTED").when(review, "MEDIUM").when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")
    rows = rows.withColumn("level", level).withColumn("confidence", F.round(score, 9))
    again = F.row_number().over(W.partitionBy("network_id", "source", "target", "level").orderBy("seq")) > 1
    return rows.select(*SEGMENT, "source", "target", "confidence", "level", (again & (F.col("level") == "HIGH")).alias("is_duplicate"))
