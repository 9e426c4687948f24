"""Spatial matching of boxes, segments and texts within a network: candidates by grid cells, scores, ranks, greedy choices.

Range joins get an equality key: every box is listed under the grid cells that it reaches, so
the join hashes on (network_id, cell) instead of pairing all rows of a network. Greedy, order-dependent
choices run as folds over one network's sorted candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g


def cells(low_x: Column, high_x: Column, low_y: Column, high_y: Column, size: float) -> Column:
    """The grid cells of a range, as strings."""
    index = lambda v: F.floor(v / size)
    rows = F.sequence(index(low_y), index(high_y))
    return F.flatten(F.transform(F.sequence(index(low_x), index(high_x)), lambda i: F.transform(rows, lambda j: F.concat_ws(":", i, j))))


def near_pairs(points: DataFrame, boxes: DataFrame, x: str, y: str, reach: float, keys: list[str]) -> DataFrame:
    """Rows of points with rows of boxes (columns prefixed b_) whose area lies within reach of (x, y); once a pair.

    keys: columns of points that name a row within its network."""
    b = boxes.select(*(F.col(c).alias(c if c == "network_id" else f"b_{c}") for c in boxes.columns))
    size = max(2 * reach, 50.0)
    spread = b.withColumn("cell", F.explode(cells(F.col("b_x") - reach, F.col("b_x") + F.col("b_width") + reach, F.col("b_y") - reach, F.col("b_y") + F.col("b_height") + reach, size)))
    placed = points.withColumn("cell", F.concat_ws(":", F.floor(F.col(x) / size), F.floor(F.col(y) / size)))
    inside = g.outside_distance(g.Point(F.col(x), F.col(y)), g.box("b_")) <= reach
    return placed.join(spread, ["network_id", "cell"]).filter(inside).drop("cell")


def text_shape_score(text: g.Box, shape: g.Box) -> Column:
    """0.4 contained + 0.2 overlap + 0.3 nearness of centres (200) + 0.1 centred position."""
    tc, sc = g.center(text), g.center(shape)
    far = g.distance(tc, sc)
    off = F.abs((tc.x - shape.x) / F.greatest(shape.width, F.lit(1.0)) - 0.5) + F.abs((tc.y - shape.y) / F.greatest(shape.height, F.lit(1.0)) - 0.5)
    return (
        F.when(g.contains(shape, tc), 0.4).otherwise(0.0)
        + g.overlap_of_first(text, shape) * 0.2
        + F.when(far < 200, (1 - far / 200) * 0.3).otherwise(0.0)
        + F.greatest(F.lit(0.0), 1 - off) * 0.1
    )


def text_arrow_score(text: g.Box, a: g.Point, b: g.Point) -> Column:
    """0.4 nearness to the middle (100) + 0.35 to the line (50) + 0.25 to the segment (100); the line is taken between its ends, too."""
    tc = g.center(text)
    mid = g.distance(tc, g.Point((a.x + b.x) / 2, (a.y + b.y) / 2))
    far = g.segment_distance(tc, a, b)
    part = lambda d, reach, weight: F.when(d < reach, (1 - d / reach) * weight).otherwise(0.0)
    return part(mid, 100.0, 0.4) + part(far, 50.0, 0.35) + part(far, 100.0, 0.25)


def text_associations(regions: DataFrame, shapes: DataFrame, arrows: DataFrame, least: float = 0.1) -> DataFrame:
    """(network_id, region_id, kind, target_id, score) with score >= least. Scores need a centre within 200, so the grid covers all."""
    r = regions.withColumn("cx", F.col("x") + F.col("width") / 2).withColumn("cy", F.col("y") + F.col("height") / 2)
    to_shape = near_pairs(r, shapes.select("network_id", "node_id", "x", "y", "width", "height"), "cx", "cy", 200.0, ["region_id"])
    shape_rows = to_shape.select("network_id", "region_id", F.lit("shape").alias("kind"), F.col("b_node_id").alias("target_id"), text_shape_score(g.box(), g.box("b_")).alias("score"))
    hull = arrows.select(
        "network_id", "segment_id", "x1", "y1", "x2", "y2",
        F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), F.abs(F.col("x1") - F.col("x2")).alias("width"), F.abs(F.col("y1") - F.col("y2")).alias("height"),
    )
    to_arrow = near_pairs(r, hull, "cx", "cy", 100.0, ["region_id"])
    ends = g.Point(F.col("b_x1"), F.col("b_y1")), g.Point(F.col("b_x2"), F.col("b_y2"))
    arrow_rows = to_arrow.select("network_id", "region_id", F.lit("arrow").alias("kind"), F.col("b_segment_id").alias("target_id"), text_arrow_score(g.box(), *ends).alias("score"))
    return shape_rows.unionByName(arrow_rows).filter(F.col("score") >= least)


def best_associations(found: DataFrame, margin: float = 0.15) -> DataFrame:
    """Each region's best target, its runner-up's score, and whether the two are too close to tell."""
    order = W.partitionBy("network_id", "region_id").orderBy(F.desc(F.round("score", 9)), "kind", "target_id")
    rows = found.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    return rows.filter("rank = 1").select("network_id", "region_id", "kind", "target_id", "score", "second", (F.coalesce(F.col("score") - F.col("second"), F.lit(1.0)) < margin).alias("is_ambiguous"))


def nearest_nodes(points: DataFrame, boxes: DataFrame, x: str, y: str, keys: list[str], reach: float = 120.0, k: int = 4) -> DataFrame:
    """The k best boxes within reach of each point: score 1 - distance to the boundary / reach, 0.4 more inside."""
    p, b = g.Point(F.col(x), F.col(y)), g.box("b_")
    pairs = near_pairs(points, boxes, x, y, reach, keys)
    far = g.outside_distance(p, b)
    scored = pairs.withColumn("distance", far).withColumn("score", F.greatest(F.lit(0.0), 1 - far / reach) + F.when(g.contains(b, p), 0.4).otherwise(0.0))
    order = W.partitionBy("network_id", *keys).orderBy(F.desc(F.round("score", 9)), "b_seq")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def k_nearest(boxes: DataFrame, k: int = 3) -> DataFrame:
    """(network_id, node_id, neighbours): the k boxes of the network with the nearest centres, nearest first.

    Distances have no bound, so this pairs all boxes of a network; networks are diagrams of tens of boxes."""
    a = boxes.select("network_id", "node_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    b = a.select("network_id", F.col("node_id").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    far = g.distance(g.Point(F.col("cx"), F.col("cy")), g.Point(F.col("ox"), F.col("oy")))
    pairs = a.join(b, "network_id").filter("node_id <> other").withColumn("distance", F.round(far, 6))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("network_id", "node_id").orderBy("distance", "other"))).filter(F.col("rank") <= k)
    return ranked.groupBy("network_id", "node_id").agg(F.expr("array_sort(collect_list(struct(rank, other))).other").alias("neighbours"))


def same_shape(a: str, b: str) -> str:
    """SQL: two shape structs depict one shape (overlap, containment within 5 pixels, or near centres of similar sizes)."""
    wide = f"greatest(0D, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    high = f"greatest(0D, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"
    area_a, area_b = f"({a}.width * {a}.height)", f"({b}.width * {b}.height)"
    least_area = f"if(least({area_a}, {area_b}) > 0, least({area_a}, {area_b}), 1D)"
    same = f"({a}.shape_type = {b}.shape_type)"

    def inside(p: str, q: str) -> str:
        return f"({p}.x >= {q}.x - 5 and {p}.y >= {q}.y - 5 and {p}.x + {p}.width <= {q}.x + {q}.width + 5 and {p}.y + {p}.height <= {q}.y + {q}.height + 5)"

    def alike(limit: float) -> str:
        return f"(least({a}.width, {b}.width) / greatest({a}.width, {b}.width) > {limit} and least({a}.height, {b}.height) / greatest({a}.height, {b}.height) > {limit})"

    dx, dy = f"({a}.x + {a}.width / 2 - {b}.x - {b}.width / 2)", f"({a}.y + {a}.height / 2 - {b}.y - {b}.height / 2)"
    near = f"sqrt({dx} * {dx} + {dy} * {dy}) / sqrt(({area_a} + {area_b}) / 2) < if({same}, 0.15D, 0.08D)"
    return f"({wide} * {high} / {least_area} >= if({same}, 0.5D, 0.6D) or (({inside(a, b)} or {inside(b, a)}) and ({same} or {alike(0.5)})) or ({alike(0.6)} and {near}))"


def suppress_duplicates(shapes: DataFrame) -> DataFrame:
    """The shapes that greedy suppression keeps: by confidence, each drops all others that depict the same shape."""
    fields = "confidence, seq, node_id, shape_type, x, y, width, height"
    rows = shapes.groupBy("network_id").agg(F.expr(f"array_sort(collect_list(struct(-{fields.split(',')[0]} as rank, {fields.split(', ', 1)[1]})))").alias("all"))
    kept = f"aggregate(all, filter(all, x -> false), (kept, s) -> if(exists(kept, k -> {same_shape('k', 's')}), kept, array_append(kept, s)))"
    return rows.select("network_id", F.explode(F.expr(kept)).alias("s")).select("network_id", "s.node_id", "s.shape_type")


def without_outliers(shapes: DataFrame, least: int = 5, small: float = 0.3, large: float = 1.5) -> DataFrame:
    """Shapes without rectangles and squares whose area is far from the median of their network's (halfway between the middle two); networks of few ones keep all."""
    area = F.col("width") * F.col("height")
    box = F.col("shape_type").isin("rectangle", "square")
    middle = shapes.filter(box).groupBy("network_id").agg(F.median(area).alias("middle"), F.count("*").alias("boxes"))
    rows = shapes.join(middle, "network_id", "left")
    odd = box & (F.col("boxes") >= least) & (F.col("middle") > 0) & ((area > large * F.col("middle")) | (area < small * F.col("middle")))
    return rows.filter(~F.coalesce(odd, F.lit(False))).drop("middle", "boxes")


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs (network_id, gt_id, det_id) of candidates (score, distance): best score first, then distance and ids."""
    rows = pairs.groupBy("network_id").agg(F.expr("array_sort(collect_list(struct(-score as rank, distance, gt_id, det_id)))").alias("all"))
    chosen = "aggregate(all, filter(all, x -> false), (m, c) -> if(exists(m, k -> k.gt_id = c.gt_id or k.det_id = c.det_id), m, array_append(m, c)))"
    return rows.select("network_id", F.explode(F.expr(chosen)).alias("m")).select("network_id", "m.gt_id", "m.det_id", (-F.col("m.rank")).alias("score"))


def admissible_pairs(truth: DataFrame, detected: DataFrame, least_iou: float = 0.2, tolerance: float = 40.0) -> DataFrame:
    """Candidates (network_id, gt_id, det_id, score, distance): boxes by IoU, or else by centres within max(tolerance, half the larger diagonal)."""
    a, b = g.box("a_"), g.box("b_")
    t = truth.select("network_id", F.col("node_id").alias("gt_id"), *(F.col(c).alias(f"a_{c}") for c in g.Box._fields))
    d = detected.select("network_id", F.col("node_id").alias("det_id"), *(F.col(c).alias(f"b_{c}") for c in g.Box._fields))
    diagonal = lambda x: F.sqrt(x.width * x.width + x.height * x.height)
    reference = F.greatest(diagonal(a), diagonal(b))
    far = g.distance(g.center(a), g.center(b))
    by_iou = g.iou(a, b) >= least_iou
    rows = t.join(d, "network_id").withColumn("by_iou", by_iou).filter(by_iou | (far <= F.greatest(F.lit(tolerance), 0.5 * reference)))
    score = F.when(F.col("by_iou"), g.iou(a, b)).otherwise(1 - far / F.greatest(reference, F.lit(1e-6)))
    distance = F.when(F.col("by_iou"), float("inf")).otherwise(far)
    return rows.select("network_id", "gt_id", "det_id", F.round(score, 9).alias("score"), F.round(distance, 9).alias("distance"))


def text_groups(regions: DataFrame, across: float = 50.0, down: float = 30.0, overall: float = 100.0) -> DataFrame:
    """Groups of two regions or more around seeds: in order, an unused region starts a group and takes every later unused one near it."""
    dx, dy = "abs(s.cx - r.cx)", "abs(s.cy - r.cy)"
    far = f"sqrt({dx} * {dx} + {dy} * {dy})"
    near = f"({far} <= {overall} and (({dx} < {across} and {dy} < {down * 3}) or ({dy} < {down} and {dx} < {across}) or {far} < {overall * 0.5}))"
    r = regions.withColumn("cx", F.col("x") + F.col("width") / 2).withColumn("cy", F.col("y") + F.col("height") / 2)
    rows = r.groupBy("network_id").agg(F.expr("array_sort(collect_list(struct(seq, region_id, text, x, y, width, height, cx, cy, confidence)))").alias("all"))
    # each region joins the first seed near it, or becomes a seed
    seeds = f"aggregate(all, filter(all, x -> false), (seeds, r) -> if(exists(seeds, s -> {near}), seeds, array_append(seeds, r)))"
    rows = rows.withColumn("seeds", F.expr(seeds))
    flat = rows.select("network_id", F.explode(F.expr(f"transform(all, r -> named_struct('r', r, 'seed', filter(seeds, s -> s.seq <= r.seq and {near})[0].seq))")).alias("m"))
    flat = flat.select("network_id", F.coalesce("m.seed", "m.r.seq").alias("seed"), "m.r.*")
    out = flat.groupBy("network_id", "seed").agg(
        F.count("*").alias("size"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"),
        F.expr("array_join(array_sort(collect_list(struct(y, x, text))).text, ' ')").alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )
    return out.filter("size >= 2")
