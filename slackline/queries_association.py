"""Queries on arrows and the nodes at their ends, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackline.operators import association
from slackline.plans import derived
from slackline.plans.derived_sql import BOXES, SEGMENTS
from slackline.queries_spatial import within

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _end_score(px: str, py: str, sign: int) -> str:
    """SQL of an end's score; b is the node, s the arrow with its unit direction dx, dy."""
    hits = []
    for edge, axis, low, size in (("b.x", "x", "b.y", "b.height"), ("b.x + b.width", "x", "b.y", "b.height"), ("b.y", "y", "b.x", "b.width"), ("b.y + b.height", "y", "b.x", "b.width")):
        p, q, d, e = (px, py, "s.dx", "s.dy") if axis == "x" else (py, px, "s.dy", "s.dx")
        t = f"((({edge}) - {p}) / nullif({sign} * {d}, 0))"
        hits.append(f"CASE WHEN abs({d}) > 1e-9 AND {t} >= 0 AND {q} + {t} * {sign} * {e} BETWEEN {low} - 1 AND {low} + {size} + 1 THEN {t} END")
    return ", ".join(hits)


def _scored(end: str, px: str, py: str, sign: int) -> str:
    inner = f"least({px} - b.x, b.x + b.width - {px}, {py} - b.y, b.y + b.height - {py})"
    ox, oy = f"({px} - greatest(b.x, least({px}, b.x + b.width)))", f"({py} - greatest(b.y, least({py}, b.y + b.height)))"
    return f"""SELECT s.network_id, s.segment_id, '{end}' AS "end", b.node_id, b.seq AS bseq, list_min(list_filter([{_end_score(px, py, sign)}], lambda v: v IS NOT NULL)) AS t,
      CASE WHEN {within(px, py, 'b')} THEN {inner} ELSE sqrt({ox} * {ox} + {oy} * {oy}) END AS edge, b.x + b.width / 2 - {px} AS ux, b.y + b.height / 2 - {py} AS uy, s.dx, s.dy, {sign} AS sign,
      ({px} BETWEEN b.x - 10 AND b.x + b.width + 10 AND {py} BETWEEN b.y - 10 AND b.y + b.height + 10) AS ins, b.confidence AS shape, s.confidence AS arrow FROM a s JOIN boxes b ON b.network_id = s.network_id"""


SCORES = f"""WITH {BOXES}, {SEGMENTS}, n AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM segments), a AS (SELECT *, (x2 - x1) / len AS dx, (y2 - y1) / len AS dy FROM n WHERE len >= 1e-6),
e AS ({_scored('source', 's.x1', 's.y1', -1)} UNION ALL {_scored('target', 's.x2', 's.y2', 1)}),
f AS (SELECT *, sqrt(ux * ux + uy * uy) AS apart, abs(atan2(uy, ux) - atan2(dy, dx) - CASE WHEN sign = 1 THEN 0 ELSE pi() END) % (2 * pi()) AS raw FROM e),
h AS (SELECT *, CASE WHEN raw > pi() THEN 2 * pi() - raw ELSE raw END AS turn, CASE WHEN t IS NOT NULL THEN least(1.0, CASE WHEN t <= 30 THEN 1 - t / 30 * 0.3 ELSE greatest(0.0, 1 - t / 90) END + 0.2) WHEN edge <= 15 THEN greatest(0.0, 1 - edge / 15) ELSE 0 END AS boundary,
  CASE WHEN edge <= 15 THEN 1 - edge / 15 * 0.5 WHEN edge <= 45 THEN greatest(0.0, 0.5 - (edge - 15) / 30 * 0.5) ELSE 0 END AS near_end, CASE WHEN apart < 1e-6 THEN 0.5 ELSE (sign * (dx * ux + dy * uy) / apart + 1) / 2 END AS way FROM f),
i AS (SELECT *, 0.10 * CASE WHEN turn <= radians(45) THEN 1 - turn / radians(45) * 0.5 ELSE greatest(0.0, 0.5 - (turn - radians(45)) / (pi() - radians(45)) * 0.5) END + 0.05 * shape + 0.05 * arrow AS tail FROM h),
j AS (SELECT network_id, segment_id, "end", node_id, bseq, round(CASE WHEN 1 - apart / 30 > 0.9 THEN 0.9 + 0.1 * way WHEN ins THEN 0.35 * 0.8 + 0.25 * boundary + 0.15 * near_end + 0.05 * way + tail ELSE 0.35 * boundary + 0.25 * near_end + 0.2 * way + tail END, 9) AS score FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY network_id, segment_id, "end" ORDER BY score DESC, bseq) AS rank FROM j WHERE score >= 0.15)"""


@query("ev04_end_scores", f'{SCORES} SELECT network_id, segment_id, "end", node_id, round(score, 6) AS score FROM k WHERE rank <= 10')
def end_scores(spark, d):
    rows = association.end_scores(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))
    return rows.select("network_id", "segment_id", "end", "node_id", F.round("score", 6).alias("score"))


@query("jn06_associated_arrows", f"""{SCORES}, p AS (SELECT s.network_id, s.segment_id, max(CASE WHEN "end" = 'source' AND rank = 1 THEN node_id END) AS s1, max(CASE WHEN "end" = 'source' AND rank = 2 THEN node_id END) AS s2, max(CASE WHEN "end" = 'target' AND rank = 1 THEN node_id END) AS t1, max(CASE WHEN "end" = 'target' AND rank = 2 THEN node_id END) AS t2,
max(CASE WHEN "end" = 'source' AND rank = 1 THEN score END) - max(CASE WHEN "end" = 'source' AND rank = 2 THEN score END) AS sm, max(CASE WHEN "end" = 'target' AND rank = 1 THEN score END) - max(CASE WHEN "end" = 'target' AND rank = 2 THEN score END) AS tm FROM segments s LEFT JOIN k ON k.network_id = s.network_id AND k.segment_id = s.segment_id GROUP BY ALL)
SELECT network_id, segment_id, CASE WHEN s1 = t1 AND NOT coalesce(t2 <> s1, false) AND s2 <> t1 THEN s2 ELSE s1 END AS source, CASE WHEN s1 = t1 AND t2 <> s1 THEN t2 ELSE t1 END AS target, coalesce(sm < 0.15, false) AS source_is_ambiguous, coalesce(tm < 0.15, false) AS target_is_ambiguous,
CASE WHEN s1 IS NULL THEN 'no_valid_source' WHEN t1 IS NULL THEN 'no_valid_target' WHEN s1 = t1 AND NOT coalesce(t2 <> s1, false) AND NOT coalesce(s2 <> t1, false) THEN 'self_association_no_alternative' END AS reason FROM p""")
def associated(spark, d):
    return association.associated(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))


def _border(p: str, q: str) -> str:
    in_x, in_y = f"{p} BETWEEN b.x - 15 AND b.x + b.width + 15", f"{q} BETWEEN b.y - 15 AND b.y + b.height + 15"
    return f"(((abs({p} - b.x) < 15 OR abs({p} - b.x - b.width) < 15) AND {in_y}) OR ((abs({q} - b.y) < 15 OR abs({q} - b.y - b.height) < 15) AND {in_x}))"


STROKES = f"{SEGMENTS}, strokes AS (SELECT network_id, segment_id, seq, x1, y1, x2, y2 FROM segments UNION ALL SELECT network_id, 'E' || node_id, seq, x + 2, y - 3, x + width - 5, y + 4 FROM boxes WHERE seq % 3 = 0)"


@query("jn09_border_strokes", f"WITH {BOXES}, {STROKES} SELECT DISTINCT s.network_id, s.segment_id FROM strokes s JOIN boxes b ON b.network_id = s.network_id WHERE {_border('s.x1', 's.y1')} AND {_border('s.x2', 's.y2')}")
def border_strokes(spark, d):
    """Segments, and strokes along the upper edges of some boxes."""
    boxes = derived.diagram_boxes(spark, d)
    edges = boxes.filter("seq % 3 = 0").select("network_id", F.concat(F.lit("E"), "node_id").alias("segment_id"), "seq", (F.col("x") + 2).alias("x1"), (F.col("y") - 3).alias("y1"), (F.col("x") + F.col("width") - 5).alias("x2"), (F.col("y") + 4).alias("y2"))
    strokes = derived.diagram_segments(spark, d).select(edges.columns).unionByName(edges)
    return association.border_strokes(strokes, boxes)


def _ring(p: str, q: str, name: str) -> str:
    far = f"sqrt(({p} - r.cx) * ({p} - r.cx) + ({q} - r.cy) * ({q} - r.cy))"
    return f"min_by(r.node_id, (round(abs({far} - r.r), 9), r.seq)) AS {name}, min_by({far} < r.r OR abs({far} - r.r) <= least(20, greatest(4, 0.4 * r.r)), (round(abs({far} - r.r), 9), r.seq)) AS {name}_in"


@query("dd09_event_checks", f"""WITH {BOXES}, {SEGMENTS}, judged AS (SELECT network_id FROM boxes GROUP BY network_id HAVING count(*) FILTER (shape_type = 'circle') >= 2 AND count(*) FILTER (shape_type = 'circle') >= 0.5 * count(*)),
rings AS (SELECT network_id, node_id, seq, x + width / 2 AS cx, y + height / 2 AS cy, (width + height) / 4 AS r FROM boxes WHERE shape_type = 'circle' AND network_id IN (SELECT network_id FROM judged)),
n AS (SELECT s.network_id, s.segment_id, {_ring('s.x1', 's.y1', 'a')}, {_ring('s.x2', 's.y2', 'b')} FROM segments s JOIN rings r ON r.network_id = s.network_id GROUP BY ALL)
SELECT s.network_id, s.segment_id, CASE WHEN n.a IS NOT NULL AND s.head_conf < 0.2 THEN CASE WHEN a_in AND b_in AND n.a = n.b THEN 'circle_boundary_same_event_no_arrowhead' WHEN NOT a_in AND NOT b_in THEN 'no_event_contact_no_arrowhead' END END AS reason FROM segments s LEFT JOIN n ON n.network_id = s.network_id AND n.segment_id = s.segment_id""")
def event_checks(spark, d):
    return association.event_checks(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))


@query("dd04_arrow_groups")
def arrow_groups(spark, d):
    """Seed-anchored groups of arrows and near copies, which depend on their order. Tested against a plain loop."""
    s = derived.diagram_segments(spark, d)
    copy = s.select("network_id", F.concat(F.lit("R"), "segment_id").alias("segment_id"), (F.col("seq") + 100).alias("seq"), *[(F.col(c) + 4).alias(c) for c in ("x1", "y1", "x2", "y2")], "head_conf", (1 - F.col("confidence")).alias("confidence"))
    return association.deduplicate_arrows(s.unionByName(copy))
