"""Queries on pairs, suppression, rings and topology, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g
from slackline.operators import direction, evidence, graph, pairing, spatial, validate
from slackline.plans import derived
from slackline.plans.derived_sql import BOXES, NETWORKS, REGIONS, SEGMENTS
from slackline.queries_networks import VALIDATION, dirty
from slackline.queries_spatial import TCX, TCY, outside, within

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("jn07_candidate_pairs", f"""WITH {BOXES}, {SEGMENTS},
a AS (SELECT s.network_id, s.segment_id, b.node_id, row_number() OVER (PARTITION BY s.network_id, s.segment_id ORDER BY round(greatest(0.0, 1 - {outside('s.x1', 's.y1', 'b')} / 120) + CASE WHEN {within('s.x1', 's.y1', 'b')} THEN 0.4 ELSE 0 END, 9) DESC, b.seq) AS r FROM segments s JOIN boxes b ON b.network_id = s.network_id WHERE {outside('s.x1', 's.y1', 'b')} <= 120),
e AS (SELECT s.network_id, s.segment_id, b.node_id, row_number() OVER (PARTITION BY s.network_id, s.segment_id ORDER BY round(greatest(0.0, 1 - {outside('s.x2', 's.y2', 'b')} / 120) + CASE WHEN {within('s.x2', 's.y2', 'b')} THEN 0.4 ELSE 0 END, 9) DESC, b.seq) AS r FROM segments s JOIN boxes b ON b.network_id = s.network_id WHERE {outside('s.x2', 's.y2', 'b')} <= 120),
p AS (SELECT a.network_id, a.segment_id, a.node_id AS node_a, e.node_id AS node_b, row_number() OVER (PARTITION BY a.network_id, a.segment_id, least(a.node_id, e.node_id), greatest(a.node_id, e.node_id) ORDER BY a.r * 10 + e.r) AS k FROM a JOIN e ON a.network_id = e.network_id AND a.segment_id = e.segment_id WHERE a.r <= 4 AND e.r <= 4 AND a.node_id <> e.node_id)
SELECT network_id, segment_id, node_a, node_b FROM p WHERE k = 1""")
def candidate_pairs(spark, d):
    pairs = pairing.candidate_pairs(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))
    return pairs.select("network_id", "segment_id", F.col("a_node_id").alias("node_a"), F.col("b_node_id").alias("node_b"))


@query("ev05_pair_scores")
def pair_scores(spark, d):
    """Eleven geometric factors of each candidate pair. Tested against plain Python."""
    rows = pairing.scored_pairs(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))
    return rows.select("network_id", "segment_id", F.col("a_node_id").alias("node_a"), F.col("b_node_id").alias("node_b"), "score")


@query("ev06_resolved_pairs")
def resolved_pairs(spark, d):
    """Best pairs with margins and verdicts. Tested against plain Python."""
    return pairing.resolved_pairs(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))


@query("ev07_resolved_directions")
def directions(spark, d):
    """Both orientations of each resolved pair, the better one with margin and verdict. Tested against plain Python."""
    seg, boxes = direction.in_geometric_order(derived.diagram_segments(spark, d)), derived.diagram_boxes(spark, d)
    return direction.resolved_directions(pairing.resolved_pairs(seg, boxes), seg, boxes)


@query("ev08_direction_evidence")
def direction_evidence(spark, d):
    """The independent evidence of both orientations. Tested against plain Python."""
    seg, boxes = direction.in_geometric_order(derived.diagram_segments(spark, d)), derived.diagram_boxes(spark, d)
    return direction.orientations(pairing.resolved_pairs(seg, boxes), seg, boxes).select("network_id", "segment_id", "source", "target", "independent")


@query("ev09_validated_dependencies")
def validated(spark, d):
    """Pairs and directions combined to accepted, reviewed and rejected dependencies. Tested against plain Python."""
    return direction.validated_dependencies(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))


CROSS = []
for along, start, step, other, other_step, lo, hi in (("b.x", "s.x1", "(s.x2 - s.x1)", "s.y1", "(s.y2 - s.y1)", "b.y", "b.y + b.height"), ("b.x + b.width", "s.x1", "(s.x2 - s.x1)", "s.y1", "(s.y2 - s.y1)", "b.y", "b.y + b.height"), ("b.y", "s.y1", "(s.y2 - s.y1)", "s.x1", "(s.x2 - s.x1)", "b.x", "b.x + b.width"), ("b.y + b.height", "s.y1", "(s.y2 - s.y1)", "s.x1", "(s.x2 - s.x1)", "b.x", "b.x + b.width")):
    t = f"((({along}) - {start}) / nullif({step}, 0))"
    CROSS.append(f"coalesce({t} > 0 AND {t} < 1 AND {other} + {t} * {other_step} BETWEEN {lo} - 1 AND {hi} + 1, false)")


@query("ev05_crossed_boxes", f"WITH {BOXES}, {SEGMENTS} SELECT s.network_id, s.segment_id, count(*) FILTER ({' OR '.join(CROSS)}) AS crossed, round(min({outside('s.x1', 's.y1', 'b')}), 6) AS gap1, round(min({outside('s.x2', 's.y2', 'b')}), 6) AS gap2 FROM segments s JOIN boxes b ON b.network_id = s.network_id GROUP BY ALL")
def crossed(spark, d):
    facts = pairing.segment_facts(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))
    return facts.select("network_id", "segment_id", F.size("crossed").cast("long").alias("crossed"), F.round("gap1", 6).alias("gap1"), F.round("gap2", 6).alias("gap2"))


@query("pr21_arrow_confidence", f"WITH {SEGMENTS}, l AS (SELECT *, least(1.0, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 150) AS reach FROM segments) SELECT network_id, segment_id, round(CASE WHEN head_conf > 0 THEN least(1.0, 0.2 * confidence + 0.4 * head_conf + 0.2 * reach + 0.2) ELSE 0.15 * confidence + 0.1 * reach END, 9) AS arrow_confidence FROM l")
def arrow_confidence(spark, d):
    c = pairing.arrow_confidence(F.col("confidence"), g.distance(pairing.first_end(), pairing.second_end()), F.col("head_conf"))
    return derived.diagram_segments(spark, d).select("network_id", "segment_id", F.round(c, 9).alias("arrow_confidence"))


@query("dd02_segment_suppression")
def segment_suppression(spark, d):
    """Order-dependent merging of repeated shafts (each segment and a near copy of it). Tested against a plain loop."""
    seg = derived.diagram_segments(spark, d)
    copy = seg.select("network_id", F.concat(F.lit("R"), "segment_id").alias("segment_id"), (F.col("seq") + 100).alias("seq"), (F.col("x1") + 1.5).alias("x1"), (F.col("y1") + 1.5).alias("y1"), (F.col("x2") + 1.5).alias("x2"), (F.col("y2") + 1.5).alias("y2"), "head_conf", (1 - F.col("confidence")).alias("confidence"))
    return pairing.suppress_segments(seg.unionByName(copy))


@query("dd05_text_suppression")
def text_suppression(spark, d):
    """Order-dependent suppression of repeated texts. Tested against a plain loop."""
    return pairing.suppress_texts(derived.text_regions(spark, d))


@query("st01_text_union", f"WITH {REGIONS}, u AS (SELECT network_id, region_id, text, confidence, 0 AS part FROM regions UNION ALL SELECT network_id, 'C' || region_id, text, confidence - 0.05, 1 FROM regions WHERE seq % 2 = 0) SELECT network_id, text, max_by(region_id, (confidence, -part, region_id)) AS region_id FROM u GROUP BY network_id, text")
def text_union(spark, d):
    """Regions of two passes; of equal texts the most confident."""
    r = derived.text_regions(spark, d).select("network_id", "region_id", "text", "confidence", F.lit(0).alias("part"), "seq")
    other = r.filter("seq % 2 = 0").select("network_id", F.concat(F.lit("C"), "region_id").alias("region_id"), "text", (F.col("confidence") - 0.05).alias("confidence"), F.lit(1).alias("part"), "seq")
    best = r.unionByName(other).groupBy("network_id", "text").agg(F.max(F.struct("confidence", (-F.col("part")).alias("part"), "region_id")).alias("m"))
    return best.select("network_id", "text", F.col("m.region_id").alias("region_id"))


RINGS = f"WITH {BOXES}, {SEGMENTS}, rings AS (SELECT network_id, node_id, seq, x + width / 2 AS cx, y + height / 2 AS cy, (width + height) / 4 AS r FROM boxes WHERE shape_type = 'circle'), f AS (SELECT s.network_id, s.segment_id, e.node_id, abs(sqrt((s.x1 - e.cx) * (s.x1 - e.cx) + (s.y1 - e.cy) * (s.y1 - e.cy)) - e.r) AS off, e.seq, e.r, sqrt((s.x1 - e.cx) * (s.x1 - e.cx) + (s.y1 - e.cy) * (s.y1 - e.cy)) AS far FROM segments s JOIN rings e ON e.network_id = s.network_id)"


def rings(spark, d):
    b = derived.diagram_boxes(spark, d).filter("shape_type = 'circle'")
    r = b.select("network_id", "node_id", F.col("seq").alias("ring_seq"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"), ((F.col("width") + F.col("height")) / 4).alias("r"))
    rows = derived.diagram_segments(spark, d).join(r, "network_id")
    return rows.withColumn("far", g.distance(pairing.first_end(), g.Point(F.col("cx"), F.col("cy")))).withColumn("off", F.abs(F.col("far") - F.col("r")))


@query("jn10_nearest_ring", f"{RINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY network_id, segment_id ORDER BY round(off, 9), seq) AS k FROM f WHERE off <= least(20, greatest(4, 0.4 * r))) SELECT network_id, segment_id, node_id, round(off, 6) AS off FROM k WHERE k = 1")
def nearest_ring(spark, d):
    near = rings(spark, d).filter(F.col("off") <= F.least(F.lit(20.0), F.greatest(F.lit(4.0), 0.4 * F.col("r"))))
    best = near.groupBy("network_id", "segment_id").agg(F.min(F.struct(F.round("off", 9).alias("o"), "ring_seq", "node_id", "off")).alias("m"))
    return best.select("network_id", "segment_id", "m.node_id", F.round("m.off", 6).alias("off"))


@query("jn11_endpoint_event", f"{RINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY network_id, segment_id ORDER BY round(far, 9), seq) AS k FROM f WHERE far <= 1.4 * r + 15) SELECT s.network_id, s.segment_id, k.node_id FROM segments s LEFT JOIN k ON k.network_id = s.network_id AND k.segment_id = s.segment_id AND k.k = 1")
def endpoint_event(spark, d):
    near = rings(spark, d).filter(F.col("far") <= 1.4 * F.col("r") + 15)
    best = near.groupBy("network_id", "segment_id").agg(F.min(F.struct(F.round("far", 9).alias("o"), "ring_seq", "node_id")).alias("m"))
    return derived.diagram_segments(spark, d).select("network_id", "segment_id").join(best, ["network_id", "segment_id"], "left").select("network_id", "segment_id", "m.node_id")


@query("jn12_closest_element", f"WITH {BOXES}, {SEGMENTS}, f AS (SELECT s.network_id, s.segment_id, b.node_id, row_number() OVER (PARTITION BY s.network_id, s.segment_id ORDER BY round(sqrt((s.x2 - b.x - b.width / 2) * (s.x2 - b.x - b.width / 2) + (s.y2 - b.y - b.height / 2) * (s.y2 - b.y - b.height / 2)), 9), b.shape_type = 'circle', b.seq) AS k FROM segments s JOIN boxes b ON b.network_id = s.network_id) SELECT network_id, segment_id, node_id FROM f WHERE k = 1")
def closest_element(spark, d):
    """The element with the nearest centre, without bound; activities before events on ties."""
    b = derived.diagram_boxes(spark, d).select("network_id", "node_id", F.col("seq").alias("box_seq"), (F.col("shape_type") == "circle").alias("is_event"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    rows = derived.diagram_segments(spark, d).join(b, "network_id")
    best = rows.groupBy("network_id", "segment_id").agg(F.min(F.struct(F.round(g.distance(pairing.second_end(), g.Point(F.col("cx"), F.col("cy"))), 9).alias("far"), "is_event", "box_seq", "node_id")).alias("m"))
    return best.select("network_id", "segment_id", "m.node_id")


@query("jn13_contained_text", f"WITH {BOXES}, {REGIONS}, f AS (SELECT b.network_id, b.node_id, r.text, row_number() OVER (PARTITION BY b.network_id, b.node_id ORDER BY r.seq) AS k FROM boxes b JOIN regions r ON r.network_id = b.network_id WHERE b.shape_type = 'circle' AND {within(TCX, TCY, 'b')}) SELECT network_id, node_id, text FROM f WHERE k = 1")
def contained_text(spark, d):
    """The first text whose centre a circle contains."""
    r = derived.text_regions(spark, d).withColumn("cx", F.col("x") + F.col("width") / 2).withColumn("cy", F.col("y") + F.col("height") / 2)
    circles = derived.diagram_boxes(spark, d).filter("shape_type = 'circle'").select("network_id", "node_id", "x", "y", "width", "height")
    pairs = spatial.near_pairs(r, circles, "cx", "cy", 0.0, ["region_id"]).filter(g.contains(g.box("b_"), g.Point(F.col("cx"), F.col("cy"))))
    best = pairs.groupBy("network_id", "b_node_id").agg(F.min(F.struct("seq", "text")).alias("m"))
    return best.select("network_id", F.col("b_node_id").alias("node_id"), "m.text")


TOPOLOGY = f"""{VALIDATION}, ends AS (SELECT i.network_id, max(CAST(NOT EXISTS (SELECT 1 FROM good g WHERE g.network_id = i.network_id AND g.target = i.activity_id) AS INTEGER)) AS has_source, max(CAST(NOT EXISTS (SELECT 1 FROM good g WHERE g.network_id = i.network_id AND g.source = i.activity_id) AS INTEGER)) AS has_sink FROM ids i GROUP BY i.network_id),
t AS (SELECT network_id, CASE WHEN code LIKE 'unknown%' THEN 'invalid_edge' ELSE code END AS code, CASE WHEN code IN ('self_loop', 'cycle') OR code LIKE 'unknown%' THEN 'ERROR' ELSE 'WARNING' END AS severity FROM issues WHERE code NOT IN ('missing_activity_id', 'duplicate_edge')
  UNION ALL SELECT network_id, 'duplicate_id', 'ERROR' FROM dirty_activities GROUP BY network_id, activity_id HAVING count(*) > 1
  UNION ALL SELECT network_id, 'suspicious_duration', 'WARNING' FROM dirty_activities WHERE coalesce(duration, 0) <= 0 OR duration > 40
  UNION ALL SELECT network_id, 'no_sources', 'WARNING' FROM ends WHERE has_source = 0 UNION ALL SELECT network_id, 'no_sinks', 'WARNING' FROM ends WHERE has_sink = 0)
SELECT network_id, code, severity, count(*) AS n FROM t GROUP BY ALL"""


@query("va06_topology_report", TOPOLOGY)
def topology(spark, d):
    """All issues of reconstructed networks by severity; durations above 40 are suspicious here."""
    rows = validate.topology_issues(*dirty(spark, d), longest=40.0)
    return rows.groupBy("network_id", "code", "severity").agg(F.count("*").alias("n"))


@query("va06_ends", f"WITH {NETWORKS}, d AS (SELECT * FROM dependencies WHERE network_id % 3 <> 0) SELECT a.network_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM d WHERE d.network_id = a.network_id AND d.t = a.seq)) AS sources, count(*) FILTER (NOT EXISTS (SELECT 1 FROM d WHERE d.network_id = a.network_id AND d.s = a.seq)) AS sinks FROM activities a GROUP BY a.network_id")
def ends(spark, d):
    """Every third network is given without its edges, so that the counts differ."""
    acts = derived.activities(spark, d)
    deps = derived.dependencies(acts).filter("network_id % 3 <> 0")
    return graph.ends(acts, deps).groupBy("network_id").agg(F.count_if("is_source").alias("sources"), F.count_if("is_sink").alias("sinks"))


RECON = """recon AS (SELECT p_partkey AS activity, p_partkey // 20 AS network_id, CASE p_partkey % 9 WHEN 0 THEN 'INFERRED_' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN 'A' ELSE 'A' || CAST(p_partkey % 14 AS VARCHAR) END AS activity_id, CASE WHEN p_partkey % 8 = 0 THEN 0.0 ELSE p_size * 1.0 END::DOUBLE AS duration, (p_partkey % 100) / 100.0::DOUBLE AS confidence, p_partkey % 5 <> 0 AS has_text FROM part)"""


def recon(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, F.concat(F.lit("INFERRED_"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 9 == 1, "A").otherwise(F.concat(F.lit("A"), (k % 14).cast("string")))
    return derived.read(spark, d, "part").select(k.alias("activity"), F.expr("p_partkey div 20").alias("network_id"), name.alias("activity_id"), F.when(k % 8 == 0, 0.0).otherwise(F.col("p_size") * 1.0).alias("duration"), (k % 100 / 100.0).alias("confidence"), (k % 5 != 0).alias("has_text"))


@query("va10_ambiguities", f"WITH {RECON} SELECT network_id, kind, activity FROM (SELECT network_id, 'duplicate_label' AS kind, activity, count(*) OVER (PARTITION BY network_id, activity_id) AS n FROM recon) WHERE n > 1 UNION ALL SELECT network_id, 'no_text', activity FROM recon WHERE NOT has_text UNION ALL SELECT network_id, 'inferred_id', activity FROM recon WHERE activity_id LIKE 'INFERRED\\_%' ESCAPE '\\'")
def ambiguities(spark, d):
    return evidence.ambiguities(recon(spark, d)).select("network_id", "kind", "activity")


@query("va09_reconstruction_issues", f"WITH {RECON} SELECT network_id, code, severity, count(*) AS n FROM (SELECT network_id, 'duplicate_activity_id' AS code, 'ERROR' AS severity FROM recon GROUP BY network_id, activity_id HAVING count(*) > 1 UNION ALL SELECT network_id, 'missing_duration', 'WARNING' FROM recon WHERE duration <= 0 UNION ALL SELECT network_id, 'low_confidence', 'INFO' FROM recon WHERE confidence < 0.3) GROUP BY ALL")
def reconstruction_issues(spark, d):
    return evidence.reconstruction_issues(recon(spark, d)).groupBy("network_id", "code", "severity").agg(F.count("*").alias("n"))


@query("va11_build_blockers", f"WITH {RECON}, b AS (SELECT network_id, activity_id, count(*) AS n, min(duration) AS d FROM recon GROUP BY ALL) SELECT r.network_id, CASE WHEN bool_or(b.n > 1 OR b.d <= 0) THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS status FROM (SELECT DISTINCT network_id FROM recon) r JOIN b USING (network_id) GROUP BY r.network_id")
def blockers(spark, d):
    rows = evidence.reconstruction_issues(recon(spark, d)).filter("code in ('duplicate_activity_id', 'missing_duration')").select("network_id").distinct().withColumn("blocked", F.lit(True))
    return recon(spark, d).select("network_id").distinct().join(rows, "network_id", "left").select("network_id", F.when(F.col("blocked"), "REVIEW_REQUIRED").otherwise("READY").alias("status"))


@query("va12_review_issues", f"WITH {RECON} SELECT activity, list_aggregate(list_filter([CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN NOT has_text THEN 'no_text' END, CASE WHEN duration <= 0 THEN 'no_duration' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS issues FROM recon WHERE confidence < 0.5 OR NOT has_text OR duration <= 0")
def review_issues(spark, d):
    return evidence.review_issues(recon(spark, d)).select("activity", F.array_join("issues", ",").alias("issues"))


@query("wn04_suffixed_ids", f"WITH {RECON}, k AS (SELECT activity, network_id, activity_id, row_number() OVER (PARTITION BY network_id, activity_id ORDER BY activity) - 1 AS k FROM recon) SELECT activity, activity_id || CASE WHEN k > 0 THEN '_' || CAST(k AS VARCHAR) ELSE '' END AS unique_id FROM k")
def suffixed(spark, d):
    rows = recon(spark, d).withColumn("id", F.col("activity_id"))
    return rows.select("activity", evidence.suffixed_ids(rows, ["network_id"], ["activity"]).alias("unique_id"))


@query("ev21_cluster_outliers", f"WITH {BOXES}, s AS (SELECT network_id, list_sort(list(width * height)) AS a, list_sort(list(width / height)) AS r FROM boxes GROUP BY network_id), m AS (SELECT network_id, a[len(a) // 2 + 1] AS area, r[len(r) // 2 + 1] AS aspect FROM s) SELECT b.network_id, b.node_id, CAST(b.width * b.height < 0.4 * m.area OR b.width * b.height > 2.5 * m.area AS INTEGER) + CAST(b.width / b.height < 0.5 * m.aspect OR b.width / b.height > 2 * m.aspect AS INTEGER) AS negatives FROM boxes b JOIN m USING (network_id)")
def cluster_outliers(spark, d):
    """How many size signals of a box lie far from its network's upper medians."""
    boxes = derived.diagram_boxes(spark, d).withColumn("area", g.area(g.box())).withColumn("aspect", F.col("width") / F.col("height"))
    mid = boxes.groupBy("network_id").agg(F.expr("sort_array(collect_list(area))[cast(count(*) div 2 as int)]").alias("ma"), F.expr("sort_array(collect_list(aspect))[cast(count(*) div 2 as int)]").alias("mr"))
    a, r = F.col("area"), F.col("aspect")
    off = ((a < 0.4 * F.col("ma")) | (a > 2.5 * F.col("ma"))).cast("int") + ((r < 0.5 * F.col("mr")) | (r > 2 * F.col("mr"))).cast("int")
    return boxes.join(mid, "network_id").select("network_id", "node_id", off.alias("negatives"))


@query("ev20_start_finish", f"WITH {NETWORKS}, g AS (SELECT a.network_id, a.activity_id, (SELECT count(*) FROM dependencies d WHERE d.network_id = a.network_id AND d.t = a.seq) AS i, (SELECT count(*) FROM dependencies d WHERE d.network_id = a.network_id AND d.s = a.seq) AS o FROM activities a) SELECT network_id, activity_id, CASE WHEN i = 0 AND o = 0 THEN 'isolated' WHEN i = 0 THEN 'start' WHEN o = 0 THEN 'finish' ELSE 'inner' END AS role FROM g")
def start_finish(spark, d):
    acts = derived.activities(spark, d)
    i, o = F.col("in_degree"), F.col("out_degree")
    return graph.degrees(acts, derived.dependencies(acts)).select("network_id", "activity_id", F.when((i == 0) & (o == 0), "isolated").when(i == 0, "start").when(o == 0, "finish").otherwise("inner").alias("role"))


@query("wn01_margin", "WITH k AS (SELECT l_orderkey, l_linenumber, l_extendedprice, lead(l_extendedprice) OVER w AS second, row_number() OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey)) SELECT l_orderkey, l_extendedprice AS best, round(l_extendedprice - second, 2) AS margin FROM k WHERE r = 1")
def margin(spark, d):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = derived.read(spark, d, "lineitem").withColumn("second", F.lead("l_extendedprice").over(w)).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return rows.select("l_orderkey", F.col("l_extendedprice").alias("best"), F.round(F.col("l_extendedprice") - F.col("second"), 2).alias("margin"))
