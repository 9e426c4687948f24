"""Queries over reconciliation, event networks and whole benchmarks, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackline.operators import event_accuracy, evidence, metrics, reconcile, spatial
from slackline.plans import derived
from slackline.plans.derived_sql import BOXES, SEGMENTS
from slackline.plans.iterate import cut
from slackline.queries_records import EDGE_ACC, F1, FIRST_STAGE, RUNS, detected_edges, run_status, stage_metrics

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- reconciliation -----------------------------------------------------------------------


def candidates(spark, d):
    """Boxes as candidate activities: inferred, shared and missing ids, labels of terminals, odd sizes, weak boxes, missing durations."""
    k, s = F.col("network_id"), F.col("seq")
    number = F.lpad(s.cast("string"), 2, "0")
    name = F.when(s % 8 == 3, F.concat(F.lit("INFERRED_0"), number)).when((k % 5 == 0) & (s == 7), "A06").otherwise(F.concat(F.lit("A"), number))
    label = F.when((k % 3 == 0) & (s == 0), "Start").when((k % 3 == 0) & (s == 24), "the end").otherwise("")
    status = F.when(s % 8 == 3, "INFERRED").when((k % 6 == 1) & (s == 9), "REVIEW_REQUIRED").otherwise("CONFIRMED")
    return derived.diagram_boxes(spark, d).select(
        "network_id", "node_id", "seq", name.alias("activity_id"), label.alias("label"), "x", "y", F.when((k % 2 == 0) & (s == 9), F.col("width") * 9).otherwise(F.col("width")).alias("width"), "height",
        F.when((k % 4 == 2) & (s == 9), 0.1).otherwise(F.col("confidence")).alias("confidence"), F.when((k % 4 == 0) & (s == 5), 0.0).otherwise(s + 1.0).alias("duration"), status.alias("status"), (s % 2).alias("n_texts"),
    )


def candidate_edges(spark, d):
    """A chain over all boxes of a network, by ids; with gaps, a self arrow, repeated edges and a way back in some."""
    rows = candidates(spark, d).select("network_id", "seq", "activity_id")
    after = rows.select("network_id", (F.col("seq") - 1).alias("seq"), F.col("activity_id").alias("target"))
    k, s = F.col("network_id"), F.col("seq")
    chain = rows.withColumnRenamed("activity_id", "source").join(after, ["network_id", "seq"]).filter((k % 3 != 1) | (s % 9 != 8))
    again = chain.filter((k % 7 == 0) & (s < 3))
    back = rows.filter((k % 5 == 3) & (s == 20)).select("network_id", F.col("activity_id").alias("source"), F.lit("A02").alias("target"))
    loops = rows.filter((k % 4 == 1) & (s == 1)).select("network_id", F.col("activity_id").alias("source"), F.col("activity_id").alias("target"))
    edges = chain.unionByName(again).select("network_id", "source", "target")
    return edges.unionByName(back).unionByName(loops)


CANDIDATES = f"""{BOXES}, cand AS (SELECT network_id, node_id, seq, CASE WHEN seq % 8 = 3 THEN 'INFERRED_0' || lpad(CAST(seq AS VARCHAR), 2, '0') WHEN network_id % 5 = 0 AND seq = 7 THEN 'A06' ELSE 'A' || lpad(CAST(seq AS VARCHAR), 2, '0') END AS activity_id,
  CASE WHEN network_id % 3 = 0 AND seq = 0 THEN 'start' WHEN network_id % 3 = 0 AND seq = 24 THEN 'finish' ELSE '' END AS term, x, y, CASE WHEN network_id % 2 = 0 AND seq = 9 THEN width * 9 ELSE width END AS width, height,
  CASE WHEN network_id % 4 = 2 AND seq = 9 THEN 0.1 ELSE confidence END AS confidence, CASE WHEN network_id % 4 = 0 AND seq = 5 THEN 0.0 ELSE seq + 1.0 END AS duration, CASE WHEN seq % 8 = 3 THEN 'INFERRED' WHEN network_id % 6 = 1 AND seq = 9 THEN 'REVIEW_REQUIRED' ELSE 'CONFIRMED' END AS status, seq % 2 AS n_texts FROM boxes),
chain AS (SELECT a.network_id, a.seq, a.activity_id AS source, b.activity_id AS target FROM cand a JOIN cand b ON b.network_id = a.network_id AND b.seq = a.seq + 1 WHERE a.network_id % 3 <> 1 OR a.seq % 9 <> 8),
edges AS (SELECT network_id, source, target FROM chain UNION ALL SELECT network_id, source, target FROM chain WHERE network_id % 7 = 0 AND seq < 3 UNION ALL SELECT network_id, activity_id, 'A02' FROM cand WHERE network_id % 5 = 3 AND seq = 20
  UNION ALL SELECT network_id, activity_id, activity_id FROM cand WHERE network_id % 4 = 1 AND seq = 1),
deg AS (SELECT c.*, (SELECT count(*) FROM edges e WHERE e.network_id = c.network_id AND e.target = c.activity_id) AS i, (SELECT count(*) FROM edges e WHERE e.network_id = c.network_id AND e.source = c.activity_id) AS o, x + width / 2 AS cx, y + height / 2 AS cy,
  length(activity_id) <= 3 AND activity_id NOT LIKE 'INFERRED%' AND n_texts > 0 AS own FROM cand c),
norm AS (SELECT *, (cx - min(cx) OVER w) / CASE WHEN max(cx) OVER w > min(cx) OVER w THEN max(cx) OVER w - min(cx) OVER w ELSE 1 END AS nx, (cy - min(cy) OVER w) / CASE WHEN max(cy) OVER w > min(cy) OVER w THEN max(cy) OVER w - min(cy) OVER w ELSE 1 END AS ny FROM deg WINDOW w AS (PARTITION BY network_id)),
ends AS (SELECT *, term = 'start' OR (NOT own AND i = 0 AND o >= 3) OR (NOT own AND term = '' AND NOT (i = 0 AND o >= 3) AND NOT (o = 0 AND i >= 3) AND i + o <= 1 AND nx < 0.1 AND ny < 0.1 AND i = 0) AS is_start,
  term = 'finish' OR (NOT own AND o = 0 AND i >= 3) OR (NOT own AND term = '' AND NOT (i = 0 AND o >= 3) AND NOT (o = 0 AND i >= 3) AND i + o <= 1 AND nx > 0.9 AND ny > 0.9 AND o = 0) AS is_finish FROM norm),
sizes AS (SELECT network_id, CAST(count(*) AS INTEGER) AS n, list_sort(list(width)) AS w, list_sort(list(height)) AS h, list_sort(list(width / height)) AS r FROM cand GROUP BY network_id),
quart AS (SELECT network_id, n, w[CASE WHEN n >= 4 THEN n // 4 ELSE 0 END + 1] AS w1, w[CASE WHEN n >= 4 THEN 3 * n // 4 ELSE n - 1 END + 1] AS w3, h[CASE WHEN n >= 4 THEN n // 4 ELSE 0 END + 1] AS h1, h[CASE WHEN n >= 4 THEN 3 * n // 4 ELSE n - 1 END + 1] AS h3, r[n // 2 + 1] AS r2 FROM sizes),
sim AS (SELECT e.*, CASE WHEN n < 3 THEN 0.5 ELSE round(greatest(0.0, 1.0 - CASE WHEN width < w1 * 0.3 OR width > w3 * 3.0 THEN 0.4 WHEN width < w1 * 0.5 OR width > w3 * 2.0 THEN 0.2 ELSE 0.0 END - CASE WHEN height < h1 * 0.3 OR height > h3 * 3.0 THEN 0.4 WHEN height < h1 * 0.5 OR height > h3 * 2.0 THEN 0.2 ELSE 0.0 END
  - CASE WHEN width / height / r2 < 0.3 OR width / height / r2 > 3.0 THEN 0.3 WHEN width / height / r2 < 0.5 OR width / height / r2 > 2.0 THEN 0.15 ELSE 0.0 END), 9) END AS similarity FROM ends e JOIN quart USING (network_id)),
judged AS (SELECT *, CASE WHEN is_start OR is_finish THEN 'REVIEW_REQUIRED' WHEN bad >= 2 THEN 'LIKELY_FALSE_POSITIVE' WHEN bad = 1 THEN 'REVIEW_REQUIRED' WHEN activity_id NOT LIKE 'INFERRED%' AND count(*) OVER (PARTITION BY network_id, activity_id) > 1 THEN 'REVIEW_REQUIRED' ELSE 'LIKELY_REAL' END AS verdict
  FROM (SELECT *, CAST(similarity < 0.4 AS INTEGER) + CAST(confidence < 0.15 AS INTEGER) + CAST(width * height < 100 AS INTEGER) AS bad FROM sim))"""


@query("ev19_verdicts", f"WITH {CANDIDATES} SELECT network_id, node_id, CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree, is_start, is_finish, CAST(similarity AS DOUBLE) AS similarity, verdict FROM judged")
def verdicts(spark, d):
    rows = reconcile.verdicts(candidates(spark, d), candidate_edges(spark, d))
    return rows.select("network_id", "node_id", "in_degree", "out_degree", "is_start", "is_finish", "similarity", "verdict")


RECONCILED = f"""WITH RECURSIVE {CANDIDATES}, live AS (SELECT DISTINCT network_id, activity_id FROM judged WHERE verdict <> 'LIKELY_FALSE_POSITIVE'),
ids AS (SELECT j.network_id, j.activity_id, min(j.seq) AS seq, min(j.duration) AS duration, count(*) AS holders FROM judged j JOIN live l ON l.network_id = j.network_id AND l.activity_id = j.activity_id GROUP BY ALL),
inn AS (SELECT e.network_id, e.source, e.target, count(*) AS n FROM edges e JOIN live a ON a.network_id = e.network_id AND a.activity_id = e.source JOIN live b ON b.network_id = e.network_id AND b.activity_id = e.target GROUP BY ALL),
arcs AS (SELECT network_id, source, target FROM inn WHERE source <> target),
removed AS (SELECT network_id, sum(CASE WHEN source = target THEN n ELSE 0 END) AS removed_self_arrows, sum(CASE WHEN source <> target THEN n - 1 ELSE 0 END) AS removed_duplicates, count(*) FILTER (source <> target) AS preserved FROM inn GROUP BY ALL),
onward(network_id, s, t) AS (SELECT network_id, source, target FROM arcs UNION SELECT o.network_id, o.s, a.target FROM onward o JOIN arcs a ON a.network_id = o.network_id AND a.source = o.t),
state AS (SELECT network_id, CASE WHEN network_id IN (SELECT network_id FROM onward WHERE s = t) THEN 'HAS_CYCLES' WHEN bool_or(NOT EXISTS (SELECT 1 FROM arcs a WHERE a.network_id = ids.network_id AND (a.source = ids.activity_id OR a.target = ids.activity_id))) THEN 'HAS_ISOLATED_NODES' ELSE 'VALID' END AS consistency, bool_or(duration <= 0) AS blank, bool_or(holders > 1) AS shared FROM ids GROUP BY network_id),
gate AS (SELECT *, CASE WHEN consistency <> 'VALID' OR blank THEN 'REVIEW_REQUIRED' WHEN shared THEN 'ERROR' ELSE 'VALID' END AS cpm_status FROM state),
fwd(network_id, activity_id, ef) AS (SELECT i.network_id, i.activity_id, i.duration FROM ids i JOIN gate g ON g.network_id = i.network_id AND g.cpm_status = 'VALID' UNION ALL SELECT b.network_id, b.activity_id, f.ef + b.duration FROM fwd f JOIN arcs a ON a.network_id = f.network_id AND a.source = f.activity_id JOIN ids b ON b.network_id = a.network_id AND b.activity_id = a.target),
whole AS (SELECT network_id, CAST(max(ef) AS DOUBLE) AS project_duration FROM fwd GROUP BY network_id),
counts AS (SELECT network_id, count(*) AS candidates, count(*) FILTER (verdict <> 'LIKELY_FALSE_POSITIVE' AND status = 'CONFIRMED') AS confirmed, count(*) FILTER (verdict <> 'LIKELY_FALSE_POSITIVE' AND status = 'INFERRED') AS inferred, count(*) FILTER (verdict <> 'LIKELY_FALSE_POSITIVE' AND status = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (verdict = 'LIKELY_FALSE_POSITIVE') AS false_positives FROM judged GROUP BY network_id)
SELECT c.*, CAST(coalesce(r.removed_self_arrows, 0) AS BIGINT) AS removed_self_arrows, CAST(coalesce(r.removed_duplicates, 0) AS BIGINT) AS removed_duplicates, coalesce(r.preserved, 0) AS preserved, g.consistency, g.cpm_status, w.project_duration,
  CASE WHEN false_positives > 0 OR review_required > 0 THEN 'REVIEW_REQUIRED' WHEN g.consistency = 'VALID' AND confirmed > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status
FROM counts c LEFT JOIN removed r USING (network_id) LEFT JOIN gate g USING (network_id) LEFT JOIN whole w USING (network_id)"""


@query("ev19_reconciliation", RECONCILED)
def reconciliation(spark, d):
    """All steps: degrees, terminals, false positives, ids, final elements, edges, consistency, schedule, status."""
    edges = cut(candidate_edges(spark, d))
    judged = cut(reconcile.verdicts(candidates(spark, d), edges))
    return reconcile.reconciled(judged, edges)[2]


# --- spatial matches ----------------------------------------------------------------------


@query("dd08_without_outliers", f"WITH {BOXES}, kinds AS (SELECT * REPLACE (CASE WHEN shape_type = 'polygon' AND seq % 2 = 0 THEN 'square' ELSE shape_type END AS shape_type) FROM boxes), m AS (SELECT network_id, median(width * height) AS mid, count(*) AS n FROM kinds WHERE shape_type IN ('rectangle', 'square') GROUP BY network_id) SELECT k.network_id, k.node_id, k.shape_type FROM kinds k LEFT JOIN m USING (network_id) WHERE NOT coalesce(k.shape_type IN ('rectangle', 'square') AND n >= 5 AND mid > 0 AND (width * height > 1.5 * mid OR width * height < 0.3 * mid), false)")
def without_outliers(spark, d):
    boxes = derived.diagram_boxes(spark, d)
    kinds = boxes.withColumn("shape_type", F.when((F.col("shape_type") == "polygon") & (F.col("seq") % 2 == 0), "square").otherwise(F.col("shape_type")))
    return spatial.without_outliers(kinds).select("network_id", "node_id", "shape_type")


@query("jn20_nearest_truth", f"WITH {BOXES}, t AS (SELECT network_id, 'G' || node_id AS gt_id, seq, round(x + 30, 0) AS gx, round(y + 20, 0) AS gy FROM boxes WHERE seq % 2 = 0), f AS (SELECT b.network_id, b.node_id, t.gt_id, row_number() OVER (PARTITION BY b.network_id, b.node_id ORDER BY round((gx - b.x - b.width / 2) * (gx - b.x - b.width / 2) + (gy - b.y - b.height / 2) * (gy - b.y - b.height / 2), 9), t.seq) AS k FROM boxes b JOIN t USING (network_id)) SELECT network_id, node_id, gt_id FROM f WHERE k = 1")
def nearest_truth(spark, d):
    boxes = derived.diagram_boxes(spark, d)
    truth = boxes.filter("seq % 2 = 0").select("network_id", F.concat(F.lit("G"), "node_id").alias("gt_id"), "seq", F.round(F.col("x") + 30, 0).alias("gx"), F.round(F.col("y") + 20, 0).alias("gy"))
    return event_accuracy.nearest_truth(boxes, truth)


def arrows(spark, d):
    """Segments between circles' places: from near one circle to near the next, some of them turned or off."""
    rows = derived.diagram_segments(spark, d)
    return rows.select("network_id", F.col("segment_id").alias("arrow_id"), "x1", "y1", "x2", "y2", F.when(F.col("seq") % 3 == 0, F.col("x2") - F.col("x1")).alias("dx"))


ENDS = f"""WITH {BOXES}, {SEGMENTS}, ev AS (SELECT network_id, node_id AS event_id, seq, x + width / 2 AS cx, y + height / 2 AS cy, (width + height) / 4 AS radius FROM boxes),
a AS (SELECT network_id, segment_id AS arrow_id, coalesce(seq % 3 = 0 AND x2 - x1 < 0, false) AS turned, x1, y1, x2, y2 FROM segments),
p AS (SELECT network_id, arrow_id, 'source' AS side, CASE WHEN turned THEN x2 ELSE x1 END AS x, CASE WHEN turned THEN y2 ELSE y1 END AS y FROM a UNION ALL SELECT network_id, arrow_id, 'target', CASE WHEN turned THEN x1 ELSE x2 END, CASE WHEN turned THEN y1 ELSE y2 END FROM a),
f AS (SELECT p.network_id, p.arrow_id, p.side, ev.event_id, row_number() OVER (PARTITION BY p.network_id, p.arrow_id, p.side ORDER BY round(sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)), 9), ev.seq) AS k FROM p JOIN ev ON ev.network_id = p.network_id AND sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) <= 1.4 * radius + 15)
SELECT a.network_id, a.arrow_id, max(f.event_id) FILTER (f.side = 'source') AS source, max(f.event_id) FILTER (f.side = 'target') AS target FROM a LEFT JOIN f ON f.network_id = a.network_id AND f.arrow_id = a.arrow_id AND f.k = 1 GROUP BY ALL"""


@query("jn22_arrow_pairs", ENDS)
def arrow_pairs(spark, d):
    b = derived.diagram_boxes(spark, d)
    events = b.select("network_id", F.col("node_id").alias("event_id"), "seq", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"), ((F.col("width") + F.col("height")) / 4).alias("radius"))
    return event_accuracy.arrow_pairs(arrows(spark, d), events)


@query("jn22_event_accuracy")
def event_networks(spark, d):
    """Shifted circles against their annotation. The matching is greedy, which SQL cannot fold; tested on a small diagram."""
    truth = derived.diagram_boxes(spark, d)
    moved = truth.filter("seq % 6 <> 5").withColumn("x", F.col("x") + 11.5).withColumn("y", F.col("y") - 7.25).withColumn("node_id", F.concat(F.lit("D"), "node_id"))
    after = truth.select("network_id", (F.col("seq") - 1).alias("seq"), F.col("node_id").alias("target"))
    edges = truth.select("network_id", "seq", F.col("node_id").alias("source")).join(after, ["network_id", "seq"]).select("network_id", "source", "target")
    return event_accuracy.compare(cut(truth), edges, cut(moved), arrows(spark, d))


# --- benchmark ----------------------------------------------------------------------------


@query("bm01_benchmark", f"WITH {RUNS}, acc AS ({EDGE_ACC} SELECT network_id, {F1} AS f1, round_even((ok / nullif(ptp, 0))::DOUBLE, 4) AS direction FROM n), st AS ({FIRST_STAGE} SELECT * FROM classified) SELECT o.image, o.status, o.outcome, st.stage, st.failure_class, acc.f1 AS dependency_f1, acc.direction AS direction_accuracy FROM o JOIN st ON st.image = o.image LEFT JOIN acc ON acc.network_id = o.image")
def benchmark(spark, d):
    """A row an image: final status, outcome, first abnormal stage and accuracy against the annotation, for all images at once."""
    stages = evidence.first_abnormal_stage(stage_metrics(spark, d)).select("image", "stage", "failure_class")
    return metrics.benchmark(run_status(spark, d), stages, metrics.edge_accuracy(*detected_edges(spark, d)))
