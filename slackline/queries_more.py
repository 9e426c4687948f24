"""Further queries: interchange formats, set and ranking semantics, statistics, resolutions, applied reviews."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g
from slackline.operators import evidence, graph, pairing, review, schedule, summary, validate
from slackline.plans import derived
from slackline.plans.iterate import cut
from slackline.plans.derived_sql import ACTIVITIES, BOXES, NETWORKS, REGIONS, SEGMENTS
from slackline.queries_networks import CPM, LEVELS, nets
from slackline.queries_records import LABELS, OCR, labels_in, ocr, stage_metrics
from slackline.sources import csv_networks, json_networks

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- interchange --------------------------------------------------------------------------


@query("sc04_parsed_predecessors", f"WITH {NETWORKS} SELECT network_id, source, target FROM dependencies")
def parsed_predecessors(spark, d):
    """Edges read back from the CSV's predecessor cells."""
    rows = csv_networks.export_rows(*nets(spark, d))
    parts = F.filter(F.split(F.coalesce("predecessors", F.lit("")), r"[,\s]+"), lambda p: p != "")
    return rows.select("network_id", F.explode(parts).alias("source"), F.col("activity_id").alias("target"))


@query("sc05_optional_numbers", f"WITH {LABELS} SELECT region, TRY_CAST(nullif(trim(text), '') AS DOUBLE) AS value FROM labels_in")
def optional_numbers(spark, d):
    return labels_in(spark, d).select("region", F.nullif(F.trim("text"), F.lit("")).try_cast("double").alias("value"))


@query("sc08_json_round_trip", f"WITH {ACTIVITIES} SELECT network_id, activity_id, seq - 1 AS seq, duration, optimistic_time, most_likely_time FROM activities")
def json_round_trip(spark, d):
    acts, deps = nets(spark, d)
    parsed = json_networks.parse(json_networks.to_json(acts, deps))
    return json_networks.activities(parsed).select("network_id", "activity_id", "seq", "duration", "optimistic_time", "most_likely_time")


@query("sc09_json_dependencies", f"WITH {NETWORKS} SELECT network_id, source, target, 'FINISH_TO_START' AS dependency_type FROM dependencies")
def json_dependencies(spark, d):
    parsed = json_networks.parse(json_networks.to_json(*nets(spark, d)))
    return json_networks.dependencies(parsed).select("network_id", "source", "target", "dependency_type")


@query("sc14_dependency_entries", f"WITH {NETWORKS} SELECT network_id, source, target FROM dependencies")
def dependency_entries(spark, d):
    """Entries written as [s, t], as source/target and as source_id/target_id, read by one expression."""
    deps = nets(spark, d)[1]
    k = (F.col("network_id") % 3).cast("int")
    pair = lambda s, t: F.to_json(F.struct(F.col("source").alias(s), F.col("target").alias(t)))
    entry = F.when(k == 0, F.to_json(F.array("source", "target"))).when(k == 1, pair("source", "target")).otherwise(pair("source_id", "target_id"))
    rows = deps.select("network_id", entry.alias("e"))
    array = F.when(F.col("e").startswith("["), F.from_json("e", "array<string>"))
    item = F.from_json("e", "source string, source_id string, target string, target_id string")
    return rows.select("network_id", F.coalesce(F.get(array, 0), item["source"], item["source_id"]).alias("source"), F.coalesce(F.get(array, 1), item["target"], item["target_id"]).alias("target"))


# --- sets, ranks, orders ------------------------------------------------------------------


@query("st04_sources", f"WITH {NETWORKS} SELECT network_id, activity_id FROM activities EXCEPT SELECT network_id, target FROM dependencies")
def sources(spark, d):
    return summary.without_predecessors(*nets(spark, d))


@query("st05_isolated", f"WITH {NETWORKS} SELECT network_id, activity_id FROM activities a WHERE NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.network_id = a.network_id AND (d.s = a.seq OR d.t = a.seq))")
def isolated(spark, d):
    return summary.without_edges(*nets(spark, d))


@query("st06_namespace_collisions", f"WITH {BOXES}, {REGIONS} SELECT DISTINCT b.network_id, substr(b.node_id, 2) AS id FROM boxes b JOIN regions r ON r.network_id = b.network_id AND substr(r.region_id, 2) = substr(b.node_id, 2)")
def collisions(spark, d):
    a = derived.diagram_boxes(spark, d).select("network_id", F.expr("substr(node_id, 2)").alias("id"))
    return summary.collisions(a, derived.text_regions(spark, d).select("network_id", F.expr("substr(region_id, 2)").alias("id")))


@query("st09_comparable", f"WITH {ACTIVITIES}, uncertain AS (SELECT network_id, activity_id FROM activities WHERE seq % 5 = 2) SELECT network_id, activity_id FROM activities EXCEPT SELECT network_id, activity_id FROM uncertain")
def comparable(spark, d):
    acts = derived.activities(spark, d)
    return summary.comparable(acts, acts.filter("seq % 5 = 2"))


@query("wn02_top_k", f"WITH {BOXES}, k AS (SELECT network_id, node_id, row_number() OVER (PARTITION BY network_id ORDER BY confidence DESC, seq) AS rank FROM boxes) SELECT * FROM k WHERE rank <= 5")
def top_k(spark, d):
    return summary.top_k(derived.diagram_boxes(spark, d), 5, [F.desc("confidence"), "seq"]).select("network_id", "node_id", "rank")


@query("wn06_first_edges", f"WITH {NETWORKS}, e AS (SELECT network_id, least(source, target) AS a, source, target, row_number() OVER (PARTITION BY network_id, least(source, target) ORDER BY greatest(source, target), source) AS k FROM dependencies) SELECT network_id, source, target FROM e WHERE k = 1")
def first_edges(spark, d):
    return summary.first_edges(nets(spark, d)[1])


@query("wn07_reading_order", f"WITH {REGIONS} SELECT network_id, string_agg(text, ' ' ORDER BY y, x, text) AS text FROM regions GROUP BY network_id")
def reading_order(spark, d):
    return derived.text_regions(spark, d).groupBy("network_id").agg(F.expr("array_join(array_sort(collect_list(struct(y, x, text))).text, ' ')").alias("text"))


@query("wn08_layer_rows", f"{LEVELS} SELECT a.network_id, a.activity_id, row_number() OVER (PARTITION BY a.network_id, l.level ORDER BY a.activity_id) - 1 AS row_index FROM activities a JOIN levels l USING (network_id, seq)")
def layer_rows(spark, d):
    return graph.layout(graph.levels(*nets(spark, d))).select("network_id", "activity_id", "row_index")


@query("so04_limited", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def limited(spark, d):
    """The limit is the operator: the first 25 by path-like order."""
    return derived.read(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(25)


@query("so06_sorted_ids", f"WITH {ACTIVITIES} SELECT network_id, string_agg(activity_id, ',' ORDER BY activity_id) AS ids FROM activities GROUP BY network_id")
def sorted_ids(spark, d):
    return derived.activities(spark, d).groupBy("network_id").agg(F.array_join(F.array_sort(F.collect_list("activity_id")), ",").alias("ids"))


# --- projections and statistics -----------------------------------------------------------


@query("pr16_crop_mapping", f"WITH {REGIONS}, {BOXES} SELECT b.network_id, b.node_id, b.x - 4 + r.x / 2.0 AS x, b.y - 4 + r.y / 2.0 AS y, r.width / 2.0 AS width FROM boxes b JOIN regions r ON r.network_id = b.network_id AND r.seq = b.seq")
def crop_mapping(spark, d):
    r = derived.text_regions(spark, d).select("network_id", "seq", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"))
    p = g.scaled(g.Point(F.col("rx"), F.col("ry")), F.lit(0.5), F.lit(0.5), F.col("x") - 4, F.col("y") - 4)
    rows = derived.diagram_boxes(spark, d).join(r, ["network_id", "seq"])
    return rows.select("network_id", "node_id", (F.col("x") - 4 + F.col("rx") / 2).alias("x"), p.y.alias("y"), (F.col("rw") / 2).alias("width"))


@query("pr20_near_border", f"WITH {BOXES} SELECT network_id, node_id, (x < 10 OR y < 10 OR x + width > 990 OR y + height > 790) AS near_border FROM boxes")
def near_border(spark, d):
    return derived.diagram_boxes(spark, d).select("network_id", "node_id", g.near_border(g.box(), 1000, 800).alias("near_border"))


@query("pr22_shape_formulas", f"WITH {BOXES}, p AS (SELECT *, 2 * (width + height) AS perimeter, 0.8 * width * height AS area FROM boxes) SELECT network_id, node_id, round(area / (width * height), 9) AS rectangularity, round(4 * pi() * area / (perimeter * perimeter), 9) AS circularity FROM p")
def shape_formulas(spark, d):
    size, edge = 0.8 * g.area(g.box()), 2 * (F.col("width") + F.col("height"))
    return derived.diagram_boxes(spark, d).select("network_id", "node_id", F.round(g.rectangularity(size, g.box()), 9).alias("rectangularity"), F.round(g.circularity(size, edge), 9).alias("circularity"))


@query("pr25_diagram_confidence", f"WITH {BOXES}, {SEGMENTS}, u AS (SELECT network_id, confidence FROM boxes UNION ALL SELECT network_id, confidence FROM segments) SELECT network_id, round(avg(confidence), 9) AS confidence FROM u GROUP BY network_id")
def diagram_confidence(spark, d):
    return summary.diagram_confidence(derived.diagram_boxes(spark, d), derived.diagram_segments(spark, d))


@query("pr27_coercions", f"WITH {LABELS} SELECT region, CASE WHEN regexp_full_match(trim(text), '[-+]?\\d+') THEN TRY_CAST(trim(text) AS BIGINT) END AS whole, TRY_CAST(text AS DOUBLE) AS number FROM labels_in")
def coercions(spark, d):
    whole = F.when(F.trim("text").rlike(r"^[-+]?\d+$"), F.trim("text").try_cast("bigint"))
    return labels_in(spark, d).select("region", whole.alias("whole"), F.col("text").try_cast("double").alias("number"))


@query("pr28_display", f"{CPM} SELECT network_id, activity_id, printf('%.2f', total_float) AS float_text, CASE WHEN is_critical THEN 'Yes' ELSE 'No' END AS critical_text FROM cpm")
def display(spark, d):
    rows = schedule.schedule(*nets(spark, d))
    return rows.select("network_id", "activity_id", F.format_string("%.2f", "total_float").alias("float_text"), F.when(F.col("is_critical"), "Yes").otherwise("No").alias("critical_text"))


@query("pr31_confident_segments", f"WITH {SEGMENTS} SELECT network_id, count(*) FILTER (confidence >= 0.4) AS confident, count(*) FILTER (head_conf > 0) AS with_head FROM segments GROUP BY network_id")
def confident(spark, d):
    return derived.diagram_segments(spark, d).groupBy("network_id").agg(F.count_if(F.col("confidence") >= 0.4).alias("confident"), F.count_if(F.col("head_conf") > 0).alias("with_head"))


@query("ag13_stage_metrics", "SELECT o_orderpriority AS class, count(CASE WHEN o_orderkey % 7 <> 0 THEN 1 END) AS with_nodes, avg(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 60 END) AS mean_nodes, max(o_orderkey % 50) AS max_shapes FROM orders GROUP BY o_orderpriority")
def class_metrics(spark, d):
    k = F.col("o_orderkey")
    rows = derived.read(spark, d, "orders").select(F.col("o_orderpriority").alias("class"), F.when(k % 7 != 0, k % 60).alias("nodes"), (k % 50).alias("shapes"))
    return summary.stage_metrics(rows, ["class"], ["nodes", "shapes"]).select("class", F.col("reports_nodes").alias("with_nodes"), F.col("mean_nodes"), F.col("largest_shapes").alias("max_shapes"))


@query("ag14_stage_progression", "SELECT o_orderkey AS image, unnest(['raw_shapes', 'arrows_detected', 'ocr_regions']) AS stage, unnest([o_orderkey % 50, (o_orderkey * 5) % 9, o_orderkey % 3]) AS n FROM orders")
def progression(spark, d):
    return summary.stage_progression(stage_metrics(spark, d), "image", ["raw_shapes", "arrows_detected", "ocr_regions"])


@query("ag21_text_confidence", f"WITH {REGIONS} SELECT network_id, round(avg(confidence), 9) AS mean_confidence, count(*) FILTER (confidence >= 0.45) AS high FROM regions GROUP BY network_id")
def text_confidence(spark, d):
    return summary.text_confidences(derived.text_regions(spark, d), high=0.45)


@query("ag23_confidence_summary", f"WITH {BOXES} SELECT network_id, min(confidence) AS least, max(confidence) AS most, round(avg(confidence), 9) AS mean FROM boxes GROUP BY network_id")
def confidence_summary(spark, d):
    return summary.confidences(derived.diagram_boxes(spark, d))


@query("ag24_status_counts", f"WITH {OCR} SELECT node_id % 10 AS batch, count(*) FILTER (raw IS NULL) AS missing, count(*) FILTER (confidence >= 0.7) AS sure, count(*) AS total FROM ocr GROUP BY ALL")
def status_counts(spark, d):
    return summary.status_counts(ocr(spark, d), [(F.col("node_id") % 10).alias("batch")], {"missing": F.col("raw").isNull(), "sure": F.col("confidence") >= 0.7})


@query("bm02_count_comparison", f"WITH {NETWORKS}, e AS (SELECT network_id, count(*) AS expected FROM activities GROUP BY ALL), f AS (SELECT network_id, count(*) AS found FROM activities WHERE seq % 4 <> 3 GROUP BY ALL) SELECT e.network_id, expected, found, abs(expected - found) AS off, round_even((found / expected)::DOUBLE, 4) AS ratio FROM e JOIN f USING (network_id)")
def count_comparison(spark, d):
    """Every fourth activity was not found."""
    acts = derived.activities(spark, d)
    return summary.count_comparison(acts, acts.filter("seq % 4 <> 3"))


# --- merging, resolution, reviews ---------------------------------------------------------

HALVES = f"""WITH RECURSIVE {SEGMENTS}, h AS (SELECT network_id, segment_id || 'a' AS segment_id, 2 * seq AS seq, x1, y1, (x1 + x2) / 2 AS x2, (y1 + y2) / 2 AS y2, confidence FROM segments UNION ALL SELECT network_id, segment_id || 'b', 2 * seq + 1, (x1 + x2) / 2, (y1 + y2) / 2, x2, y2, confidence / 2 FROM segments),
a AS (SELECT *, (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 360 AS angle FROM h),
l AS (SELECT p.network_id, p.segment_id AS s, q.segment_id AS t FROM a p JOIN a q ON p.network_id = q.network_id AND p.segment_id <> q.segment_id WHERE least(abs(p.angle - q.angle), 360 - abs(p.angle - q.angle)) <= 15 AND abs(cos(radians(p.angle - q.angle))) >= 0.85
  AND least(sqrt((p.x1 - q.x1) ** 2 + (p.y1 - q.y1) ** 2), sqrt((p.x1 - q.x2) ** 2 + (p.y1 - q.y2) ** 2), sqrt((p.x2 - q.x1) ** 2 + (p.y2 - q.y1) ** 2), sqrt((p.x2 - q.x2) ** 2 + (p.y2 - q.y2) ** 2)) <= 20),
r(network_id, s, t) AS (SELECT network_id, segment_id, segment_id FROM a UNION SELECT r.network_id, r.s, l.t FROM r JOIN l ON l.network_id = r.network_id AND l.s = r.t),
c AS (SELECT network_id, s AS segment_id, min(t) AS grp FROM r GROUP BY ALL)
SELECT a.network_id, min_by(a.segment_id, a.seq) AS segment_id, max(a.confidence) AS confidence, count(*) AS pieces FROM a JOIN c USING (network_id, segment_id) GROUP BY a.network_id, c.grp"""


@query("dd03_merged_segments", HALVES)
def merged_segments(spark, d):
    """Segments cut in halves come together again, with whatever else is collinear and near."""
    s = derived.diagram_segments(spark, d)
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    a = s.select("network_id", F.concat("segment_id", F.lit("a")).alias("segment_id"), (2 * F.col("seq")).alias("seq"), "x1", "y1", mx.alias("x2"), my.alias("y2"), "confidence")
    b = s.select("network_id", F.concat("segment_id", F.lit("b")).alias("segment_id"), (2 * F.col("seq") + 1).alias("seq"), mx.alias("x1"), my.alias("y1"), "x2", "y2", (F.col("confidence") / 2).alias("confidence"))
    return pairing.merge_segments(a.unionByName(b)).select("network_id", "segment_id", "confidence", "pieces")


CORRECT = f"""WITH {OCR}, o AS (SELECT node_id // 40 AS network_id, node_id, raw, confidence, alt1, c1, alt2, c2 FROM ocr WHERE raw IS NOT NULL),
deg AS (SELECT network_id, chr(CAST(65 + i AS INTEGER)) AS id, CASE WHEN (network_id + i) % 3 = 0 THEN 0 ELSE 2 END AS edges FROM (SELECT DISTINCT network_id FROM o), range(0, 20) t(i) UNION ALL SELECT DISTINCT network_id, '13', 2 FROM o WHERE network_id % 2 = 0),
conf AS (SELECT * FROM (VALUES ('C', ['G', 'O', 'Q']), ('G', ['C', '6']), ('O', ['Q', 'D', '0']), ('Q', ['O', 'D']), ('I', ['L', '1', 'l']), ('L', ['I', '1']), ('S', ['5', '8']), ('Z', ['2']), ('B', ['8', '13']), ('D', ['O', '0']), ('U', ['V']), ('V', ['U', 'Y']), ('M', ['N']), ('N', ['M'])) v(k, v)),
c AS (SELECT network_id, node_id, raw, confidence, raw AS id, 0.5 AS base, 0 AS rank, 0 AS place FROM o UNION ALL SELECT network_id, node_id, raw, confidence, alt1, c1 * 0.8, 1, 1 FROM o UNION ALL SELECT network_id, node_id, raw, confidence, alt2, c2 * 0.8, 1, 2 FROM o
  UNION ALL SELECT network_id, node_id, raw, confidence, v[CAST(i AS INTEGER)], 0.3, 2, 2 + i FROM o JOIN conf ON k = upper(raw), range(1, 4) t(i) WHERE i <= len(v)
  UNION ALL SELECT network_id, node_id, raw, confidence, chr(ascii(upper(raw)) + s), 0.2, 3, 8 + s FROM o, (VALUES (-1), (1)) t(s) WHERE length(raw) = 1 AND chr(ascii(upper(raw)) + s) BETWEEN 'A' AND 'Z'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY network_id, node_id, id ORDER BY place) AS k FROM c) WHERE k = 1),
g AS (SELECT f.*, d.edges, round(greatest(base + CASE WHEN d.edges > 0 THEN 0.2 WHEN d.edges = 0 THEN -0.1 ELSE 0 END + confidence * 0.1 - CASE WHEN d.edges IS NULL AND length(f.id) = 1 THEN 0.3 ELSE 0 END, 0), 9) AS score FROM f LEFT JOIN deg d ON d.network_id = f.network_id AND d.id = f.id WHERE rank < 2 OR d.edges IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY network_id, node_id ORDER BY score DESC, place) AS best FROM g)
SELECT network_id, node_id, raw, id AS corrected_id, CAST(score AS DOUBLE) AS score FROM b WHERE best = 1 AND score >= 0.6 AND id <> raw"""


@query("ev14_topology_corrections", CORRECT)
def topology_corrections(spark, d):
    rows = ocr(spark, d).filter("raw is not null").withColumn("network_id", F.expr("node_id div 40"))
    letters = rows.select("network_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    degrees = letters.select("network_id", F.expr("char(65 + i)").alias("activity_id"), F.when((F.col("network_id") + F.col("i")) % 3 == 0, 0).otherwise(1).alias("in_degree"), F.when((F.col("network_id") + F.col("i")) % 3 == 0, 0).otherwise(1).alias("out_degree"))
    longer = rows.filter("network_id % 2 = 0").select("network_id", F.lit("13").alias("activity_id"), F.lit(1).alias("in_degree"), F.lit(1).alias("out_degree")).distinct()
    return evidence.topology_corrections(rows, degrees.unionByName(longer))


APPLIED = f"""WITH {NETWORKS}, acts AS (SELECT network_id, activity_id AS raw, CASE WHEN network_id % 9 = 1 AND seq = 2 THEN 'Z02' WHEN network_id % 9 = 2 AND seq = 2 THEN 'N01' ELSE activity_id END AS activity_id, seq, duration FROM activities WHERE NOT (network_id % 9 = 0 AND seq = 3)),
edges AS (SELECT network_id, CASE WHEN network_id % 7 = 1 THEN target ELSE source END AS source, CASE WHEN network_id % 7 = 1 THEN source ELSE target END AS target FROM dependencies WHERE NOT (network_id % 7 = 0 AND source = 'N01')),
mapped AS (SELECT e.network_id, a.activity_id AS source, b.activity_id AS target FROM edges e JOIN acts a ON a.network_id = e.network_id AND a.raw = e.source JOIN acts b ON b.network_id = e.network_id AND b.raw = e.target),
final AS (SELECT DISTINCT * FROM mapped)"""


def to_review(spark, d):
    """Networks and the log of their reviews."""
    acts, deps = nets(spark, d)
    k, s = F.col("network_id"), F.col("seq")
    item = F.concat_ws(":", k.cast("string"), "activity_id")
    what = F.when((k % 9 == 0) & (s == 3), "REJECT").when((k % 9).isin(1, 2) & (s == 2), "CORRECT")
    now = F.lit("2024-01-01").cast("timestamp")
    id_log = acts.select("network_id", s.cast("long").alias("seq"), item.alias("item_id"), what.alias("decision"), now.alias("ts"), F.when(k % 9 == 1, "Z02").otherwise("N01").alias("corrected_value")).filter("decision is not null")
    edge = F.concat(k.cast("string"), F.lit(":"), "source", F.lit(">"), "target")
    how = F.when((k % 7 == 0) & (F.col("source") == "N01"), "REJECT").when(k % 7 == 1, "REVERSE")
    edge_log = deps.select("network_id", F.lit(1).cast("long").alias("seq"), edge.alias("item_id"), how.alias("decision"), now.alias("ts"), F.lit(None).cast("string").alias("new_end")).filter("decision is not null")
    return acts, deps, id_log, edge_log


def applied(spark, d):
    return review.apply(*to_review(spark, d))


@query("hr06_applied_activities", f"{APPLIED} SELECT network_id, activity_id, seq, duration FROM acts")
def applied_activities(spark, d):
    return applied(spark, d)[0].select("network_id", "activity_id", "seq", "duration")


@query("hr06_applied_dependencies", f"{APPLIED} SELECT network_id, source, target FROM final")
def applied_dependencies(spark, d):
    return applied(spark, d)[1]


@query("hr06_applied_issues", f"{APPLIED} SELECT network_id, 'duplicate_activity_id' AS code, activity_id AS element FROM acts GROUP BY network_id, activity_id HAVING count(*) > 1 UNION ALL SELECT network_id, 'duplicate_edge', source || '->' || target FROM mapped WHERE network_id % 7 = 1 GROUP BY network_id, source, target HAVING count(*) > 1")
def applied_issues(spark, d):
    return applied(spark, d)[2]


@query("hr08_review_to_schedule")
def review_to_schedule(spark, d):
    """Reviewed networks that pass every check, scheduled. A composition of operators whose parts have their own SQL."""
    return review.scheduled(*to_review(spark, d))


@query("jn17_estimate_overlay", f"WITH {ACTIVITIES} SELECT network_id, activity_id, CASE WHEN network_id % 2 = 0 THEN CASE WHEN seq % 3 = 0 THEN duration END ELSE optimistic_time END AS optimistic_time FROM activities")
def estimate_overlay(spark, d):
    """Explicit estimates are authoritative for their network: activities that they leave out have none."""
    acts = derived.activities(spark, d)
    given = acts.filter("network_id % 2 = 0 and seq % 3 = 0").select("network_id", "activity_id", F.col("duration").alias("o"))
    rows = acts.join(given, ["network_id", "activity_id"], "left")
    return rows.select("network_id", "activity_id", F.when(F.col("network_id") % 2 == 0, F.col("o")).otherwise(F.col("optimistic_time")).alias("optimistic_time"))


@query("jn19_id_remap", f"WITH {NETWORKS} SELECT d.network_id, 'A' || a.seq AS source, 'A' || b.seq AS target FROM dependencies d JOIN activities a ON a.network_id = d.network_id AND a.seq = d.s JOIN activities b ON b.network_id = d.network_id AND b.seq = d.t WHERE a.seq % 6 <> 0 AND b.seq % 6 <> 0")
def id_remap(spark, d):
    """Dependencies of node ids as dependencies of activity ids; nodes without an id drop their edges, self loops go."""
    acts, deps = nets(spark, d)
    names = acts.filter("seq % 6 <> 0").select("network_id", F.col("activity_id").alias("node"), F.concat(F.lit("A"), F.col("seq").cast("string")).alias("id"))
    s, t = (names.select("network_id", F.col("node").alias(e), F.col("id").alias(f"{e}_id")) for e in ("source", "target"))
    rows = deps.join(s, ["network_id", "source"]).join(t, ["network_id", "target"]).filter("source_id <> target_id")
    return rows.select("network_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"))


@query("va14_ground_truth_issues", f"WITH {NETWORKS}, g AS (SELECT network_id, activity_id, seq, CASE WHEN network_id % 31 = 0 THEN NULL ELSE duration END AS duration FROM activities UNION ALL SELECT network_id, activity_id, seq, duration FROM activities WHERE network_id % 37 = 0 AND seq = 1) SELECT network_id, code, count(*) AS n FROM (SELECT network_id, 'duplicate_id' AS code FROM g GROUP BY network_id, activity_id HAVING count(*) > 1 UNION ALL SELECT network_id, 'missing_duration' FROM g WHERE duration IS NULL UNION ALL SELECT network_id, 'unknown_reference' FROM dependencies WHERE network_id % 41 = 0) GROUP BY ALL")
def ground_truth_issues(spark, d):
    acts, deps = nets(spark, d)
    k = F.col("network_id")
    given = acts.select("network_id", "activity_id", F.when(k % 31 != 0, F.col("duration")).alias("duration")).unionByName(acts.filter("network_id % 37 = 0 and seq = 1").select("network_id", "activity_id", "duration"))
    edges = deps.withColumn("target", F.when(k % 41 == 0, F.concat(F.lit("?"), "target")).otherwise(F.col("target")))
    return validate.ground_truth_issues(given, edges).groupBy("network_id", "code").agg(F.count("*").alias("n"))
