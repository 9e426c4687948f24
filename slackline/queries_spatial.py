"""Queries over derived boxes, segments and text regions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g
from slackline.operators import spatial
from slackline.plans import derived
from slackline.plans.derived_sql import BOXES, REGIONS, SEGMENTS

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def numbered(rows, prefix: str):
    """Columns but network_id with a prefix."""
    return rows.select(*(F.col(c).alias(c if c == "network_id" else f"{prefix}{c}") for c in rows.columns))


def neighbours(spark, d):
    """Boxes next to each other in seq, as a_ and b_ columns."""
    boxes = derived.diagram_boxes(spark, d)
    b = numbered(boxes, "b_").withColumn("a_seq", F.col("b_seq") - 1)
    return numbered(boxes, "a_").join(b, ["network_id", "a_seq"])


def box_to_segment(spark, d):
    """Boxes with the segment of their own seq."""
    seg = derived.diagram_segments(spark, d).withColumnRenamed("confidence", "line_confidence")
    return derived.diagram_boxes(spark, d).join(seg, ["network_id", "seq"])


# SQL pieces: intersections, centres and distances of two boxes a and b
IX = "(greatest(0.0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)))"
PAIR = f"WITH {BOXES} SELECT a.network_id, a.node_id, {{0}} FROM boxes a JOIN boxes b ON a.network_id = b.network_id AND b.seq = a.seq + 1"
CDX, CDY = "(a.x + a.width / 2 - (b.x + b.width / 2))", "(a.y + a.height / 2 - (b.y + b.height / 2))"
CENTRES = f"sqrt({CDX} * {CDX} + {CDY} * {CDY})"
IOU = f"CASE WHEN a.width * a.height + b.width * b.height - {IX} > 0 THEN {IX} / (a.width * a.height + b.width * b.height - {IX}) ELSE 0 END"
SEG = f"WITH {BOXES}, {SEGMENTS} SELECT a.network_id, a.node_id, {{0}} FROM boxes a JOIN segments s ON a.network_id = s.network_id AND a.seq = s.seq"


def point_segment(px: str, py: str, s: str = "s") -> str:
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    t = f"greatest(0.0, least(1.0, (({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
    ex, ey = f"({px} - ({s}.x1 + {t} * {dx}))", f"({py} - ({s}.y1 + {t} * {dy}))"
    return f"CASE WHEN {dx} * {dx} + {dy} * {dy} = 0 THEN sqrt(({px} - {s}.x1) * ({px} - {s}.x1) + ({py} - {s}.y1) * ({py} - {s}.y1)) ELSE sqrt({ex} * {ex} + {ey} * {ey}) END"


def outside(px: str, py: str, b: str) -> str:
    ex = f"({px} - greatest({b}.x, least({px}, {b}.x + {b}.width)))"
    ey = f"({py} - greatest({b}.y, least({py}, {b}.y + {b}.height)))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def within(px: str, py: str, b: str) -> str:
    return f"({px} BETWEEN {b}.x AND {b}.x + {b}.width AND {py} BETWEEN {b}.y AND {b}.y + {b}.height)"


@query("pr01_box_metrics", f"WITH {BOXES} SELECT network_id, node_id, x + width / 2 AS center_x, y + height / 2 AS center_y, width * height AS area, x + width AS right_edge, y + height AS bottom_edge FROM boxes")
def box_metrics(spark, d):
    b = g.box()
    return derived.diagram_boxes(spark, d).select("network_id", "node_id", g.center(b).x.alias("center_x"), g.center(b).y.alias("center_y"), g.area(b).alias("area"), (b.x + b.width).alias("right_edge"), (b.y + b.height).alias("bottom_edge"))


@query("pr02_contains_point", PAIR.format(f"{within('b.x + b.width / 2', 'b.y + b.height / 2', 'a')} AS holds, (b.x + b.width / 2 BETWEEN a.x - 25 AND a.x + a.width + 25 AND b.y + b.height / 2 BETWEEN a.y - 25 AND a.y + a.height + 25) AS holds_25"))
def contains_point(spark, d):
    p = g.center(g.box("b_"))
    return neighbours(spark, d).select("network_id", F.col("a_node_id").alias("node_id"), g.contains(g.box("a_"), p).alias("holds"), g.contains(g.box("a_"), p, 25.0).alias("holds_25"))


@query("pr03_overlaps", PAIR.format(f"{IX} > 0 AND {IX} / least(a.width * a.height, b.width * b.height) >= 0.1 AS overlaps"))
def overlaps(spark, d):
    return neighbours(spark, d).select("network_id", F.col("a_node_id").alias("node_id"), g.overlaps(g.box("a_"), g.box("b_"), 0.1).alias("overlaps"))


@query("pr04_distance", SEG.format("sqrt((s.x1 - s.x2) * (s.x1 - s.x2) + (s.y1 - s.y2) * (s.y1 - s.y2)) AS length, (s.x1 + s.x2) / 2 AS mid_x, (s.y1 + s.y2) / 2 AS mid_y"))
def lengths(spark, d):
    a, b = g.Point(F.col("x1"), F.col("y1")), g.Point(F.col("x2"), F.col("y2"))
    return box_to_segment(spark, d).select("network_id", "node_id", g.distance(a, b).alias("length"), ((a.x + b.x) / 2).alias("mid_x"), ((a.y + b.y) / 2).alias("mid_y"))


@query("pr07_iou", PAIR.format(f"{IOU} AS iou, {IX} / greatest(a.width * a.height + b.width * b.height - {IX}, 1.0) AS iou_floored, {IX} / (a.width * a.height) AS overlap_of_first"))
def iou(spark, d):
    a, b = g.box("a_"), g.box("b_")
    return neighbours(spark, d).select("network_id", F.col("a_node_id").alias("node_id"), g.iou(a, b).alias("iou"), g.iou_floored(a, b).alias("iou_floored"), g.overlap_of_first(a, b).alias("overlap_of_first"))


@query("pr10_segment_distance", SEG.format(f"round({point_segment('(a.x + a.width / 2)', '(a.y + a.height / 2)')}, 6) AS distance"))
def segment_distance(spark, d):
    far = g.segment_distance(g.center(g.box()), g.Point(F.col("x1"), F.col("y1")), g.Point(F.col("x2"), F.col("y2")))
    return box_to_segment(spark, d).select("network_id", "node_id", F.round(far, 6).alias("distance"))


@query("pr12_boundary_distance", SEG.format(f"round(CASE WHEN {within('s.x1', 's.y1', 'a')} THEN least(s.x1 - a.x, a.x + a.width - s.x1, s.y1 - a.y, a.y + a.height - s.y1) ELSE {outside('s.x1', 's.y1', 'a')} END, 6) AS to_boundary, round({outside('s.x1', 's.y1', 'a')}, 6) AS to_area"))
def boundary(spark, d):
    p = g.Point(F.col("x1"), F.col("y1"))
    return box_to_segment(spark, d).select("network_id", "node_id", F.round(g.boundary_distance(p, g.box()), 6).alias("to_boundary"), F.round(g.outside_distance(p, g.box()), 6).alias("to_area"))


def _ray_sql() -> str:
    out = []
    for along, start, step, other, other_step, low, high in (
        ("x", "x1", "x2 - x1", "y1", "y2 - y1", "y", "y + height"), ("x + width", "x1", "x2 - x1", "y1", "y2 - y1", "y", "y + height"),
        ("y", "y1", "y2 - y1", "x1", "x2 - x1", "x", "x + width"), ("y + height", "y1", "y2 - y1", "x1", "x2 - x1", "x", "x + width"),
    ):
        t = f"(({along}) - {start}) / nullif({step}, 0)"
        out.append(f"CASE WHEN abs({step}) > 1e-9 AND {t} >= 0 AND {other} + {t} * ({other_step}) BETWEEN ({low}) - 1 AND ({high}) + 1 THEN {t} END")
    return ", ".join(out)


@query("pr13_ray_hits", f"WITH {BOXES}, {SEGMENTS}, r AS (SELECT a.network_id, a.node_id, a.x, a.y, a.width, a.height, s.x1, s.y1, s.x2, s.y2 FROM boxes a JOIN segments s ON a.network_id = s.network_id AND a.seq = s.seq), h AS (SELECT network_id, node_id, list_filter([{_ray_sql()}], lambda t: t IS NOT NULL) AS t FROM r) SELECT network_id, node_id, len(t) AS hits, round(list_min(t), 9) AS nearest FROM h")
def ray_hits(spark, d):
    p, dx, dy = g.Point(F.col("x1"), F.col("y1")), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = box_to_segment(spark, d)
    return rows.select("network_id", "node_id", F.size(g.ray_hits(p, dx, dy, g.box())).alias("hits"), F.round(g.nearest_hit(p, dx, dy, g.box()), 9).alias("nearest"))


SLAB = "(CASE WHEN abs({s}) < 1e-9 THEN CASE WHEN {p} BETWEEN {lo} AND {hi} THEN {a} ELSE {b} END ELSE {f}(({lo} - {p}) / nullif({s}, 0), ({hi} - {p}) / nullif({s}, 0)) END)"


def _slab(f: str, axis: str) -> str:
    size = "width" if axis == "x" else "height"
    a, b = ("'-infinity'::DOUBLE", "'infinity'::DOUBLE") if f == "least" else ("'infinity'::DOUBLE", "'-infinity'::DOUBLE")
    return SLAB.format(f=f, s=f"(s.{axis}2 - s.{axis}1)", p=f"s.{axis}1", lo=f"(a.{axis} - 4)", hi=f"(a.{axis} + a.{size} + 4)", a=a, b=b)


@query("pr14_slab_distance", SEG.format(f"round(CASE WHEN greatest(0.0, {_slab('least', 'x')}, {_slab('least', 'y')}) <= least({_slab('greatest', 'x')}, {_slab('greatest', 'y')}) THEN greatest(0.0, {_slab('least', 'x')}, {_slab('least', 'y')}) END, 9) AS enters"))
def slab(spark, d):
    far = g.slab_distance(g.Point(F.col("x1"), F.col("y1")), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), g.box(), 4.0)
    return box_to_segment(spark, d).select("network_id", "node_id", F.round(far, 9).alias("enters"))


@query("pr15_coordinate_mapping", f"WITH {BOXES} SELECT network_id, node_id, x * 1.5 + 12 AS original_x, y * 0.75 - 8 AS original_y, (x - 12) / 1.5 AS processed_x, (y + 8) / 0.75 AS processed_y, width * 1.5 AS original_width, height * 0.75 AS original_height FROM boxes")
def mapping(spark, d):
    k = [F.lit(v) for v in (1.5, 0.75, 12.0, -8.0)]
    p = g.Point(F.col("x"), F.col("y"))
    a, b = g.scaled(p, *k), g.unscaled(p, *k)
    return derived.diagram_boxes(spark, d).select("network_id", "node_id", a.x.alias("original_x"), a.y.alias("original_y"), b.x.alias("processed_x"), b.y.alias("processed_y"), (F.col("width") * 1.5).alias("original_width"), (F.col("height") * 0.75).alias("original_height"))


@query("pr17_endpoint_order", f"WITH {SEGMENTS} SELECT network_id, segment_id, CASE WHEN (x1, y1) > (x2, y2) THEN x2 ELSE x1 END AS ax, CASE WHEN (x1, y1) > (x2, y2) THEN y2 ELSE y1 END AS ay, (x1, y1) > (x2, y2) AS swapped FROM segments")
def endpoint_order(spark, d):
    swap = g.endpoint_swap(g.Point(F.col("x1"), F.col("y1")), g.Point(F.col("x2"), F.col("y2")))
    return derived.diagram_segments(spark, d).select("network_id", "segment_id", F.when(swap, F.col("x2")).otherwise(F.col("x1")).alias("ax"), F.when(swap, F.col("y2")).otherwise(F.col("y1")).alias("ay"), swap.alias("swapped"))


@query("pr18_segment_filter", f"WITH {SEGMENTS}, l AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM segments) SELECT network_id, segment_id, CASE WHEN length < 30 THEN 'too_short' WHEN length > 600 THEN 'too_long' WHEN least(x1, x2) < 5 OR least(y1, y2) < 5 OR greatest(x1, x2) > 995 OR greatest(y1, y2) > 795 THEN 'image_border' END AS reason, 0.4 + 0.6 * least(1.0, length / 150) AS line_confidence FROM l")
def segment_filter(spark, d):
    length = g.distance(g.Point(F.col("x1"), F.col("y1")), g.Point(F.col("x2"), F.col("y2")))
    border = (F.least("x1", "x2") < 5) | (F.least("y1", "y2") < 5) | (F.greatest("x1", "x2") > 995) | (F.greatest("y1", "y2") > 795)
    reason = F.when(length < 30, "too_short").when(length > 600, "too_long").when(border, "image_border")
    return derived.diagram_segments(spark, d).select("network_id", "segment_id", reason.alias("reason"), (0.4 + 0.6 * F.least(F.lit(1.0), length / 150)).alias("line_confidence"))


@query("pr19_shape_filter", f"WITH {BOXES} SELECT network_id, node_id, shape_type FROM boxes WHERE confidence >= 0.35 AND width * height >= 3000 AND width >= 20 AND height >= 20")
def shape_filter(spark, d):
    return derived.diagram_boxes(spark, d).filter((F.col("confidence") >= 0.35) & (g.area(g.box()) >= 3000) & (F.col("width") >= 20) & (F.col("height") >= 20)).select("network_id", "node_id", "shape_type")


@query("pr23_candidate_roles", f"WITH {BOXES} SELECT network_id, node_id, CASE shape_type WHEN 'rectangle' THEN 'activity' WHEN 'circle' THEN 'event' ELSE 'unknown' END AS role, width / height AS aspect_ratio, least(x, y, 1000 - x - width, 800 - y - height) AS border_distance FROM boxes")
def roles(spark, d):
    role = F.when(F.col("shape_type") == "rectangle", "activity").when(F.col("shape_type") == "circle", "event").otherwise("unknown")
    return derived.diagram_boxes(spark, d).select("network_id", "node_id", role.alias("role"), (F.col("width") / F.col("height")).alias("aspect_ratio"), F.least(F.col("x"), F.col("y"), 1000 - F.col("x") - F.col("width"), 800 - F.col("y") - F.col("height")).alias("border_distance"))


@query("pr24_confidence_blend", f"WITH {BOXES}, m AS (SELECT network_id, max(confidence) AS top FROM boxes GROUP BY ALL) SELECT b.network_id, round(0.4 * m.top + 0.6 * coalesce(avg(confidence) FILTER (confidence <> m.top), m.top), 9) AS confidence FROM boxes b JOIN m USING (network_id) GROUP BY b.network_id, m.top")
def blend(spark, d):
    rows = derived.diagram_boxes(spark, d).filter("confidence <> 0").groupBy("network_id").agg(F.max("confidence").alias("top"), F.sort_array(F.collect_list("confidence")).alias("all"))
    rest = F.filter("all", lambda c: c != F.col("top"))
    mean = F.aggregate(rest, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(rest), F.lit(0))
    return rows.select("network_id", F.round(0.4 * F.col("top") + 0.6 * F.coalesce(mean, F.col("top")), 9).alias("confidence"))


@query("ag16_shape_counts", f"WITH {BOXES} SELECT network_id, count(*) FILTER (shape_type = 'rectangle') AS rectangles, count(*) FILTER (shape_type = 'circle') AS circles, count(*) FILTER (shape_type = 'polygon') AS polygons FROM boxes GROUP BY network_id")
def shape_counts(spark, d):
    n = lambda t: F.count_if(F.col("shape_type") == t)
    return derived.diagram_boxes(spark, d).groupBy("network_id").agg(n("rectangle").alias("rectangles"), n("circle").alias("circles"), n("polygon").alias("polygons"))


@query("ag17_size_stats", f"WITH {BOXES} SELECT network_id, round(avg(width * height), 4) AS mean_area, round(stddev_pop(width * height), 4) AS std_area, round(stddev_pop(width * height) / avg(width * height), 6) AS cv FROM boxes GROUP BY network_id")
def size_stats(spark, d):
    a = g.area(g.box())
    return derived.diagram_boxes(spark, d).groupBy("network_id").agg(F.round(F.avg(a), 4).alias("mean_area"), F.round(F.stddev_pop(a), 4).alias("std_area"), F.round(F.stddev_pop(a) / F.avg(a), 6).alias("cv"))


@query("ag18_upper_medians", f"WITH {BOXES}, s AS (SELECT network_id, list_sort(list(width * height)) AS a FROM boxes GROUP BY network_id) SELECT network_id, a[len(a) // 2 + 1] AS median_area, a[len(a) // 4 + 1] AS lower_area, a[3 * len(a) // 4 + 1] AS upper_area FROM s")
def upper_medians(spark, d):
    rows = derived.diagram_boxes(spark, d).groupBy("network_id").agg(F.sort_array(F.collect_list(g.area(g.box()))).alias("a"))
    return rows.selectExpr("network_id", "a[size(a) div 2] as median_area", "a[size(a) div 4] as lower_area", "a[3 * size(a) div 4] as upper_area")


@query("ag19_area_outliers", f"WITH {BOXES}, m AS (SELECT network_id, median(width * height) AS med, count(*) AS n FROM boxes WHERE shape_type = 'rectangle' GROUP BY network_id) SELECT b.network_id, b.node_id, coalesce(m.n >= 5 AND (width * height > 1.5 * med OR width * height < 0.3 * med), false) AS is_outlier FROM boxes b JOIN m USING (network_id) WHERE b.shape_type = 'rectangle'")
def outliers(spark, d):
    rects = derived.diagram_boxes(spark, d).filter("shape_type = 'rectangle'").withColumn("area", g.area(g.box()))
    m = rects.groupBy("network_id").agg(F.median("area").alias("med"), F.count("*").alias("n"))
    out = (F.col("n") >= 5) & ((F.col("area") > 1.5 * F.col("med")) | (F.col("area") < 0.3 * F.col("med")))
    return rects.join(m, "network_id").select("network_id", "node_id", out.alias("is_outlier"))


@query("wn03_spatial_order", f"WITH {BOXES} SELECT network_id, node_id, 'INFERRED_' || lpad(CAST(row_number() OVER (PARTITION BY network_id ORDER BY round_even(y / 40, 0), x, seq) AS VARCHAR), 3, '0') AS inferred_id FROM boxes")
def spatial_order(spark, d):
    order = W.partitionBy("network_id").orderBy(F.bround(F.col("y") / 40), "x", "seq")
    return derived.diagram_boxes(spark, d).select("network_id", "node_id", F.concat(F.lit("INFERRED_"), F.lpad(F.row_number().over(order).cast("string"), 3, "0")).alias("inferred_id"))


KNN = f"WITH {BOXES}, p AS (SELECT a.network_id, a.node_id, b.node_id AS other, row_number() OVER (PARTITION BY a.network_id, a.node_id ORDER BY round({CENTRES}, 6), b.node_id) AS k FROM boxes a JOIN boxes b ON a.network_id = b.network_id AND a.node_id <> b.node_id)"


@query("jn15_nearest_neighbours", f"{KNN} SELECT network_id, node_id, string_agg(other, ' ' ORDER BY k) AS neighbours FROM p WHERE k <= 3 GROUP BY ALL")
def knn(spark, d):
    return spatial.k_nearest(derived.diagram_boxes(spark, d)).select("network_id", "node_id", F.array_join("neighbours", " ").alias("neighbours"))


NEAR = f"WITH {BOXES}, {SEGMENTS}, n AS (SELECT s.network_id, s.segment_id, b.node_id, {outside('s.x1', 's.y1', 'b')} AS distance, greatest(0.0, 1 - {outside('s.x1', 's.y1', 'b')} / 120) + CASE WHEN {within('s.x1', 's.y1', 'b')} THEN 0.4 ELSE 0 END AS score, b.seq FROM segments s JOIN boxes b ON b.network_id = s.network_id WHERE {outside('s.x1', 's.y1', 'b')} <= 120), k AS (SELECT *, row_number() OVER (PARTITION BY network_id, segment_id ORDER BY round(score, 9) DESC, seq) AS rank FROM n)"


@query("jn07_endpoint_candidates", f"{NEAR} SELECT network_id, segment_id, rank, node_id, round(score, 9) AS score FROM k WHERE rank <= 4")
def endpoint_candidates(spark, d):
    near = spatial.nearest_nodes(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d), "x1", "y1", ["segment_id"])
    return near.select("network_id", "segment_id", "rank", F.col("b_node_id").alias("node_id"), F.round("score", 9).alias("score"))


@query("jn08_nearest_endpoint", f"{NEAR}, f AS (SELECT network_id, segment_id, node_id, distance, row_number() OVER (PARTITION BY network_id, segment_id ORDER BY round(distance, 9), seq) AS r FROM n WHERE distance <= 40) SELECT network_id, segment_id, node_id, round(distance, 9) AS distance FROM f WHERE r = 1")
def nearest_endpoint(spark, d):
    near = spatial.near_pairs(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d), "x1", "y1", 40.0, ["segment_id"])
    far = F.round(g.outside_distance(g.Point(F.col("x1"), F.col("y1")), g.box("b_")), 9)
    first = near.groupBy("network_id", "segment_id").agg(F.min(F.struct(far.alias("distance"), "b_seq", "b_node_id")).alias("m"))
    return first.select("network_id", "segment_id", F.col("m.b_node_id").alias("node_id"), F.col("m.distance").alias("distance"))


TCX, TCY = "(r.x + r.width / 2)", "(r.y + r.height / 2)"
TOV = "(greatest(0.0, least(r.x + r.width, b.x + b.width) - greatest(r.x, b.x)) * greatest(0.0, least(r.y + r.height, b.y + b.height) - greatest(r.y, b.y)) / (r.width * r.height))"
TFAR = f"sqrt(({TCX} - (b.x + b.width / 2)) * ({TCX} - (b.x + b.width / 2)) + ({TCY} - (b.y + b.height / 2)) * ({TCY} - (b.y + b.height / 2)))"
TOFF = f"(abs(({TCX} - b.x) / greatest(b.width, 1.0) - 0.5) + abs(({TCY} - b.y) / greatest(b.height, 1.0) - 0.5))"
SHAPE_SCORE = f"(CASE WHEN {within(TCX, TCY, 'b')} THEN 0.4 ELSE 0 END + {TOV} * 0.2 + CASE WHEN {TFAR} < 200 THEN (1 - {TFAR} / 200) * 0.3 ELSE 0 END + greatest(0.0, 1 - {TOFF}) * 0.1)"
TMID = f"sqrt(({TCX} - (s.x1 + s.x2) / 2) * ({TCX} - (s.x1 + s.x2) / 2) + ({TCY} - (s.y1 + s.y2) / 2) * ({TCY} - (s.y1 + s.y2) / 2))"
TSEG = f"({point_segment(TCX, TCY)})"
ARROW_SCORE = f"(CASE WHEN {TMID} < 100 THEN (1 - {TMID} / 100) * 0.4 ELSE 0 END + CASE WHEN {TSEG} < 50 THEN (1 - {TSEG} / 50) * 0.35 ELSE 0 END + CASE WHEN {TSEG} < 100 THEN (1 - {TSEG} / 100) * 0.25 ELSE 0 END)"
ASSOCIATIONS = f"""WITH {BOXES}, {SEGMENTS}, {REGIONS}, found AS (
  SELECT r.network_id, r.region_id, 'shape' AS kind, b.node_id AS target_id, {SHAPE_SCORE} AS score FROM regions r JOIN boxes b ON b.network_id = r.network_id WHERE {SHAPE_SCORE} >= 0.1
  UNION ALL SELECT r.network_id, r.region_id, 'arrow', s.segment_id, {ARROW_SCORE} FROM regions r JOIN segments s ON s.network_id = r.network_id WHERE {ARROW_SCORE} >= 0.1)"""


def associations(spark, d):
    return spatial.text_associations(derived.text_regions(spark, d), derived.diagram_boxes(spark, d), derived.diagram_segments(spark, d))


@query("jn03_text_shape_association", f"{ASSOCIATIONS} SELECT network_id, region_id, target_id, round(score, 6) AS score FROM found WHERE kind = 'shape'")
def text_shape(spark, d):
    return associations(spark, d).filter("kind = 'shape'").select("network_id", "region_id", "target_id", F.round("score", 6).alias("score"))


@query("jn04_text_arrow_association", f"{ASSOCIATIONS} SELECT network_id, region_id, target_id, round(score, 6) AS score FROM found WHERE kind = 'arrow'")
def text_arrow(spark, d):
    return associations(spark, d).filter("kind = 'arrow'").select("network_id", "region_id", "target_id", F.round("score", 6).alias("score"))


@query("jn05_best_association", f"{ASSOCIATIONS}, k AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM found WINDOW w AS (PARTITION BY network_id, region_id ORDER BY round(score, 9) DESC, kind, target_id)) SELECT network_id, region_id, kind, target_id, round(score, 6) AS score, round(second, 6) AS second, coalesce(score - second, 1.0) < 0.15 AS is_ambiguous FROM k WHERE rank = 1")
def best(spark, d):
    return spatial.best_associations(associations(spark, d)).withColumn("score", F.round("score", 6)).withColumn("second", F.round("second", 6))


@query("dd01_shape_suppression", None)
def suppression(spark, d):
    """Greedy and order-dependent; SQL has no fold over kept rows. Tested against a plain loop."""
    return spatial.suppress_duplicates(derived.diagram_boxes(spark, d))


@query("jn16_greedy_matching", None)
def matching(spark, d):
    """Greedy one-to-one matching of boxes with their shifted copies. Tested against a plain loop."""
    boxes = derived.diagram_boxes(spark, d)
    moved = boxes.withColumn("x", F.col("x") + 11.5).withColumn("y", F.col("y") - 7.25).withColumn("node_id", F.concat(F.lit("D"), "node_id"))
    return spatial.greedy_matching(spatial.admissible_pairs(boxes, moved))


ADMISSIBLE = f"""WITH {BOXES}, moved AS (SELECT network_id, 'D' || node_id AS node_id, x + 11.5 AS x, y - 7.25 AS y, width, height FROM boxes),
c AS (SELECT a.network_id, a.node_id AS gt_id, b.node_id AS det_id, {IOU} AS iou, {CENTRES} AS far, greatest(sqrt(a.width * a.width + a.height * a.height), sqrt(b.width * b.width + b.height * b.height)) AS reference FROM boxes a JOIN moved b ON a.network_id = b.network_id)"""


@query("jn16_admissible_pairs", f"{ADMISSIBLE} SELECT network_id, gt_id, det_id, round(CASE WHEN iou >= 0.2 THEN iou ELSE 1 - far / greatest(reference, 1e-6) END, 9) AS score FROM c WHERE iou >= 0.2 OR far <= greatest(40.0, 0.5 * reference)")
def admissible(spark, d):
    boxes = derived.diagram_boxes(spark, d)
    moved = boxes.withColumn("x", F.col("x") + 11.5).withColumn("y", F.col("y") - 7.25).withColumn("node_id", F.concat(F.lit("D"), "node_id"))
    return spatial.admissible_pairs(boxes, moved).drop("distance")


@query("dd06_text_groups", None)
def groups(spark, d):
    """Seed-anchored groups, which depend on the order of regions. Tested against a plain loop."""
    return spatial.text_groups(derived.text_regions(spark, d))
