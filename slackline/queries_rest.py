"""Queries on reconstruction, remaining formulas, statistics and report tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import geometry as g
from slackline.functions import numbers, text
from slackline.operators import direction, evidence, graph, metrics, reconstruct, report, review, schedule
from slackline.plans import derived
from slackline.plans.derived_sql import ACTIVITIES, BOXES, DECISIONS, NETWORKS, REGIONS
from slackline.queries_networks import CPM, PERT_VARIANCE, WALKS, nets, pert_totals
from slackline.queries_records import LABELS, RUNS, SETTLED, detected_edges, labels_in, matched, review_values, run_status
from slackline.queries_spatial import ASSOCIATIONS, IX, PAIR, SEG, associations, box_to_segment, neighbours, point_segment
from slackline.sources import report_sinks

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- formulas -----------------------------------------------------------------------------


@query("pr06_variance", f"WITH {ACTIVITIES} SELECT network_id, activity_id, ((pessimistic_time - optimistic_time) / 6) * ((pessimistic_time - optimistic_time) / 6) AS variance FROM activities")
def variance(spark, d):
    return derived.activities(spark, d).select("network_id", "activity_id", numbers.variance(F.col("optimistic_time"), F.col("pessimistic_time")).alias("variance"))


@query("pr08_iou_floored", PAIR.format(f"{IX} / greatest(a.width * a.height + b.width * b.height - {IX}, 1.0) AS iou"))
def iou_floored(spark, d):
    return neighbours(spark, d).select("network_id", F.col("a_node_id").alias("node_id"), g.iou_floored(g.box("a_"), g.box("b_")).alias("iou"))


@query("pr09_overlap_ratio", PAIR.format(f"{IX} / (a.width * a.height) AS ratio"))
def overlap_ratio(spark, d):
    return neighbours(spark, d).select("network_id", F.col("a_node_id").alias("node_id"), g.overlap_of_first(g.box("a_"), g.box("b_")).alias("ratio"))


@query("pr11_line_distance", SEG.format(f"round({point_segment('(a.x + a.width)', '(a.y + a.height)')}, 6) AS distance"))
def line_distance(spark, d):
    """The distance to the line is taken between its ends, like that to the segment."""
    far = g.segment_distance(g.Point(F.col("x") + F.col("width"), F.col("y") + F.col("height")), g.Point(F.col("x1"), F.col("y1")), g.Point(F.col("x2"), F.col("y2")))
    return box_to_segment(spark, d).select("network_id", "node_id", F.round(far, 6).alias("distance"))


@query("pr30_derived_status", f"WITH {NETWORKS}, a AS (SELECT network_id, count(*) AS n, bool_and(duration > 0) AS ok FROM activities GROUP BY ALL), e AS (SELECT network_id, count(*) AS m FROM dependencies GROUP BY ALL) SELECT a.network_id, n AS activity_count, coalesce(m, 0) AS dependency_count, ok AS has_all_durations FROM a LEFT JOIN e USING (network_id)")
def derived_status(spark, d):
    acts, deps = nets(spark, d)
    full = acts.groupBy("network_id").agg(F.bool_and(F.col("duration") > 0).alias("has_all_durations"))
    return graph.counts(acts, deps).drop("activity_ids").join(full, "network_id")


@query("gr17_probability", f"{PERT_VARIANCE} SELECT network_id, CASE WHEN var > 0 THEN 0.5 WHEN var = 0 THEN 1.0 END AS probability FROM m")
def probability_at_mean(spark, d):
    """The chance to finish by the expected duration itself."""
    t = pert_totals(spark, d)
    return t.select("network_id", numbers.completion_probability(F.col("project_duration"), F.col("project_duration"), F.col("project_deviation")).alias("probability"))


@query("fn02_no_squeeze", f"WITH {LABELS} SELECT region, text AS squeezed FROM labels_in")
def no_squeeze(spark, d):
    """Repeated characters stay: the rule never applies."""
    return labels_in(spark, d).select("region", F.col("text").alias("squeezed"))


@query("fn06_parsed_numbers", f"WITH {LABELS} SELECT region, CAST(replace(trim(text), ',', '') AS DOUBLE) AS value, CAST(replace(trim(text), ',', '') AS DOUBLE) = floor(CAST(replace(trim(text), ',', '') AS DOUBLE)) AS is_integer FROM labels_in WHERE regexp_full_match(trim(text), '[-+]?(?:\\d[\\d,]*\\.?\\d*|\\.\\d+)')")
def parsed_numbers(spark, d):
    rows = labels_in(spark, d).filter(text.is_number(F.col("text"))).withColumn("value", text.parsed(F.trim("text")))
    return rows.select("region", "value", (F.col("value") == F.floor("value")).alias("is_integer"))


@query("fn13_duration_format", f"WITH {LABELS} SELECT region, coalesce(regexp_full_match(trim(text), '\\d+(\\.\\d+)?'), false) AS valid FROM labels_in")
def duration_format(spark, d):
    return labels_in(spark, d).select("region", text.is_duration_format(F.col("text")).alias("valid"))


@query("fn17_elapsed", "SELECT user_id, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_seen FROM events GROUP BY user_id")
def elapsed(spark, d):
    ts = F.col("ts").cast("timestamp")
    return derived.read(spark, d, "events").groupBy("user_id").agg(F.round(F.max(ts).cast("double") - F.min(ts).cast("double"), 3).alias("seconds"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_seen"))


@query("fn18_ordered_distinct", "WITH e AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS types FROM e GROUP BY user_id")
def ordered_distinct(spark, d):
    """Distinct values in order of first occurrence."""
    first = derived.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.groupBy("user_id").agg(F.expr("array_join(array_sort(collect_list(struct(first, event_type))).event_type, '>')").alias("types"))


@query("fn19_json_rows", f"WITH {ACTIVITIES} SELECT network_id, activity_id, '{{\"id\":\"' || activity_id || '\",\"seq\":' || seq || '}}' AS json FROM activities")
def json_rows(spark, d):
    return derived.activities(spark, d).select("network_id", "activity_id", F.to_json(F.struct(F.col("activity_id").alias("id"), "seq")).alias("json"))


# --- aggregates, ranks, sets --------------------------------------------------------------


@query("ag02_critical_counts", f"{CPM} SELECT network_id, count(*) FILTER (is_critical) AS critical_count, count(*) FILTER (NOT is_critical) AS non_critical_count FROM cpm GROUP BY network_id")
def critical_counts(spark, d):
    return schedule.summary(schedule.schedule(*nets(spark, d))).drop("project_duration")


@query("ag03_free_float", f"{CPM} SELECT network_id, activity_id, free_float FROM cpm")
def free_float(spark, d):
    return schedule.schedule(*nets(spark, d)).select("network_id", "activity_id", "free_float")


@query("ag09_accuracy", f"WITH {NETWORKS}, m AS (SELECT network_id, count(*) AS n, count(*) FILTER (seq % 4 <> 0) AS tp FROM activities GROUP BY ALL) SELECT network_id, CASE WHEN network_id % 10 = 0 THEN 'UNCERTAIN' ELSE 'COMPLETE' END AS status, CASE WHEN network_id % 10 <> 0 THEN round_even((tp / n)::DOUBLE, 4) END AS recall FROM m")
def accuracy(spark, d):
    """Accuracy of networks with a complete annotation; uncertain ones have none."""
    acts = derived.activities(spark, d)
    hit = acts.filter("seq % 4 <> 0").select("network_id", "activity_id")
    rows = metrics.node_accuracy(acts, hit, hit)
    sure = F.col("network_id") % 10 != 0
    return rows.select("network_id", F.when(sure, "COMPLETE").otherwise("UNCERTAIN").alias("status"), F.when(sure, F.coalesce("recall", F.lit(0.0))).alias("recall"))


@query("ag15_review_counts", f"{SETTLED} SELECT count(*) AS items, count(*) FILTER (s.status IS NULL) AS pending, count(*) FILTER (s.status = 'CORRECTED') AS corrected FROM v LEFT JOIN s USING (item_id)")
def review_counts(spark, d):
    s = review.statuses(*review_values(spark, d))
    return s.agg(F.count("*").alias("items"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "CORRECTED").alias("corrected"))


@query("ag22_text_hulls", f"WITH {REGIONS} SELECT network_id, min(x) AS x, min(y) AS y, max(x + width) AS right_edge, max(y + height) AS bottom_edge, round(avg(confidence), 9) AS confidence FROM regions GROUP BY network_id")
def text_hulls(spark, d):
    return derived.text_regions(spark, d).groupBy("network_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right_edge"), F.max(F.col("y") + F.col("height")).alias("bottom_edge"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query("wn05_draft_ids", f"WITH {REGIONS}, k AS (SELECT network_id, region_id, text, row_number() OVER (PARTITION BY network_id, text ORDER BY seq) AS k FROM regions) SELECT network_id, region_id, text || CASE WHEN k > 1 THEN '_' || CAST(k AS VARCHAR) ELSE '' END AS draft_id FROM k")
def draft_ids(spark, d):
    k = F.row_number().over(W.partitionBy("network_id", "text").orderBy("seq"))
    rows = derived.text_regions(spark, d).withColumn("k", k)
    return rows.select("network_id", "region_id", F.when(F.col("k") == 1, F.col("text")).otherwise(F.concat_ws("_", "text", "k")).alias("draft_id"))


@query("wn09_best_of_kind", f"WITH {REGIONS} SELECT network_id, max_by(text, (confidence, -seq)) FILTER (text LIKE 'A%') AS best_id, max_by(text, (confidence, -seq)) FILTER (text NOT LIKE 'A%') AS best_number FROM regions GROUP BY network_id")
def best_of_kind(spark, d):
    best = lambda cond: F.max(F.when(cond, F.struct("confidence", (-F.col("seq")).alias("s"), "text")))
    rows = derived.text_regions(spark, d).groupBy("network_id").agg(best(F.col("text").startswith("A")).alias("i"), best(~F.col("text").startswith("A")).alias("n"))
    return rows.select("network_id", F.col("i.text").alias("best_id"), F.col("n.text").alias("best_number"))


@query("so02_ranked_paths", f"{CPM}, {WALKS} SELECT network_id, count(*) AS paths, min(len(path)) AS shortest FROM whole WHERE abs(total - project_duration) < 1e-9 GROUP BY network_id")
def ranked_paths(spark, d):
    return schedule.critical_paths(*nets(spark, d)).groupBy("network_id").agg(F.count("*").alias("paths"), F.min("path_len").alias("shortest"))


@query("so03_ordered_associations", f"{ASSOCIATIONS} SELECT network_id, region_id, string_agg(target_id, ' ' ORDER BY round(score, 9) DESC, kind, target_id) AS targets FROM found GROUP BY ALL")
def ordered_associations(spark, d):
    return associations(spark, d).groupBy("network_id", "region_id").agg(F.expr("array_join(array_sort(collect_list(struct(-round(score, 9) as r, kind, target_id))).target_id, ' ')").alias("targets"))


@query("so07_by_confidence", f"WITH {BOXES} SELECT network_id, string_agg(node_id, ' ' ORDER BY confidence DESC, seq) AS nodes FROM boxes GROUP BY network_id")
def by_confidence(spark, d):
    return derived.diagram_boxes(spark, d).groupBy("network_id").agg(F.expr("array_join(array_sort(collect_list(struct(-confidence as c, seq, node_id))).node_id, ' ')").alias("nodes"))


@query("dd10_reciprocal_conflicts", f"""WITH {NETWORKS}, d AS (SELECT network_id, CASE WHEN (s + t) % 7 = 0 THEN target ELSE source END AS source, CASE WHEN (s + t) % 7 = 0 THEN source ELSE target END AS target FROM dependencies WHERE (s + t) % 5 <> 0 UNION ALL SELECT network_id, activity_id, 'N01' FROM activities WHERE seq = 4),
u AS (SELECT network_id, source, target FROM d UNION SELECT network_id, source, target FROM dependencies), p AS (SELECT network_id, least(source, target) AS low, greatest(source, target) AS high FROM u GROUP BY ALL HAVING count(*) = 2)
SELECT network_id, low AS source, high AS target FROM p UNION ALL SELECT network_id, high, low FROM p""")
def reciprocal(spark, d):
    """Edges that stand in both directions: both need a review."""
    truth, found = detected_edges(spark, d)
    u = truth.select("network_id", "source", "target").union(found.select("network_id", "source", "target")).distinct()
    back = u.select("network_id", F.col("target").alias("source"), F.col("source").alias("target"))
    return u.join(back, ["network_id", "source", "target"], "left_semi")


@query("va16_outcomes", f"WITH {RUNS} SELECT image, outcome FROM o")
def outcomes(spark, d):
    return run_status(spark, d).select("image", "outcome")


@query("va19_issue_display", f"WITH {NETWORKS}, i AS (SELECT network_id, 'isolated_activity' AS code FROM activities a WHERE NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.network_id = a.network_id AND (d.s = a.seq OR d.t = a.seq)) UNION ALL SELECT network_id, 'missing_duration' FROM activities WHERE network_id % 89 = 0 AND seq = 1) SELECT network_id, code, CASE code WHEN 'missing_duration' THEN 'duration' ELSE 'activity' END AS review_target, 'blocking' AS severity FROM i")
def issue_display(spark, d):
    """Issues with what a person reviews to settle them, by a lookup of fixed values."""
    acts, deps = nets(spark, d)
    touched = deps.select("network_id", F.col("source").alias("activity_id")).union(deps.select("network_id", "target"))
    alone = acts.join(touched, ["network_id", "activity_id"], "left_anti").select("network_id", F.lit("isolated_activity").alias("code"))
    blank = acts.filter("network_id % 89 = 0 and seq = 1").select("network_id", F.lit("missing_duration").alias("code"))
    # Code, review target, severity.
    known = spark.createDataFrame([("isolated_activity", "activity", "blocking"), ("missing_duration", "duration", "blocking"), ("cycle", "dependency", "blocking")], "code string, review_target string, severity string")
    return alone.unionByName(blank).join(known, "code").select("network_id", "code", "review_target", "severity")


# --- reconstruction -----------------------------------------------------------------------

TEXTS = f"""{ASSOCIATIONS}, t AS (SELECT f.network_id, f.target_id AS node_id, r.text, round(f.score, 9) AS score, f.region_id, regexp_full_match(r.text, '[-+]?(?:\\d[\\d,]*\\.?\\d*|\\.\\d+)') AS is_number FROM found f JOIN regions r ON r.network_id = f.network_id AND r.region_id = f.region_id WHERE f.kind = 'shape'),
shape_text AS (SELECT network_id, node_id, max_by(text, (-score, region_id)) FILTER (NOT is_number) AS id_text, CAST(max_by(text, (-score, region_id)) FILTER (is_number) AS DOUBLE) AS number FROM t GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY round_even(y / 40, 0), x, seq) AS place FROM boxes WHERE shape_type = 'rectangle'),
named AS (SELECT p.network_id, p.node_id, p.place, coalesce(s.id_text, 'INFERRED_' || lpad(CAST(p.place AS VARCHAR), 3, '0')) AS id, s.id_text IS NULL AS is_inferred, coalesce(s.number, 0) AS duration FROM placed p LEFT JOIN shape_text s USING (network_id, node_id)),
recon AS (SELECT *, id || CASE WHEN k > 1 THEN '_' || CAST(k - 1 AS VARCHAR) ELSE '' END AS activity_id FROM (SELECT *, row_number() OVER (PARTITION BY network_id, id ORDER BY place) AS k FROM named))"""


def shape_texts(spark, d):
    return reconstruct.shape_texts(associations(spark, d).filter("kind = 'shape'"), derived.text_regions(spark, d))


def activities(spark, d):
    return reconstruct.activities(derived.diagram_boxes(spark, d), shape_texts(spark, d))


@query("ev17_shape_texts", f"{TEXTS} SELECT network_id, node_id, id_text, number FROM shape_text")
def texts(spark, d):
    return shape_texts(spark, d).select("network_id", "node_id", "id_text", "number")


@query("ev15_reconstructed_activities", f"{TEXTS} SELECT network_id, node_id, activity_id, place AS seq, duration, is_inferred FROM recon")
def reconstructed(spark, d):
    return activities(spark, d)


@query("ev22_reconciled_ids", f"{TEXTS} SELECT network_id, node_id, CASE WHEN activity_id LIKE 'INFERRED%' OR count(*) OVER (PARTITION BY network_id, activity_id) > 1 THEN 'REVIEW_REQUIRED' ELSE 'CONFIRMED' END AS status FROM recon")
def reconciled(spark, d):
    return reconstruct.reconciled_ids(activities(spark, d)).select("network_id", "node_id", "status")


@query("hr01_review_items", f"{TEXTS} SELECT network_id, node_id AS item_id, 'activity' AS item_type, 'inferred_id' AS reason FROM recon WHERE is_inferred UNION ALL SELECT network_id, node_id, 'duration', 'no_duration' FROM recon WHERE duration <= 0")
def review_items(spark, d):
    return reconstruct.review_items(activities(spark, d))


@query("hr09_pending_by_category", f"{TEXTS} SELECT network_id, count(*) FILTER (is_inferred) AS activities, count(*) FILTER (duration <= 0) AS durations FROM recon WHERE is_inferred OR duration <= 0 GROUP BY network_id")
def pending(spark, d):
    n = lambda t: F.count_if(F.col("item_type") == t)
    return reconstruct.review_items(activities(spark, d)).groupBy("network_id").agg(n("activity").alias("activities"), n("duration").alias("durations"))


@query("ev18_reconstructed_dependencies")
def reconstructed_dependencies(spark, d):
    """Accepted segments as dependencies of reconstructed activities; builds on ev09, which is tested against plain Python."""
    found = direction.validated_dependencies(derived.diagram_segments(spark, d), derived.diagram_boxes(spark, d))
    return reconstruct.dependencies(found, activities(spark, d))


ARROWS = "arrows AS (SELECT l_orderkey AS network_id, 'N' || lpad(CAST(seq AS VARCHAR), 2, '0') AS activity_id, seq, seq // 2 AS from_event, seq // 2 + 1 AS to_event, l_quantity AS duration FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS seq FROM lineitem))"


def arrows(spark, d):
    acts = derived.activities(spark, d)
    return acts.select("network_id", "activity_id", "seq", F.expr("seq div 2").alias("from_event"), F.expr("seq div 2 + 1").alias("to_event"), "duration")


@query("gr05_event_edges", f"WITH {ARROWS} SELECT network_id, from_event, to_event, max_by(activity_id, seq) AS activity_id, count(*) AS parallel FROM arrows GROUP BY ALL")
def event_edges(spark, d):
    return reconstruct.event_network(arrows(spark, d))


@query("ev16_event_network_schedule", f"WITH {ARROWS}, longest AS (SELECT network_id, from_event, max(duration) AS d FROM arrows GROUP BY ALL) SELECT network_id, sum(d) AS project_duration FROM longest GROUP BY network_id")
def event_schedule(spark, d):
    """Activities on arrows as a network of activities, scheduled: here events form a chain, so the longest arrow of each step adds up."""
    a = arrows(spark, d)
    deps = report.event_precedence(a.withColumn("confidence", F.lit(1.0))).select("network_id", "source", "target")
    return schedule.summary(schedule.schedule(a.select("network_id", "activity_id", "seq", "duration"), deps)).select("network_id", "project_duration")


# --- editing, reviews, reports ------------------------------------------------------------


@query("gr23_edited_network", f"WITH {NETWORKS} SELECT network_id, CASE WHEN seq = 1 THEN 'START' ELSE activity_id END AS activity_id, CASE WHEN seq = 2 THEN duration + 5 ELSE duration END AS duration FROM activities WHERE seq <> 5 UNION ALL SELECT DISTINCT network_id, 'EXTRA', 1.0 FROM activities")
def edited(spark, d):
    """An edit log (rename, update, remove, add) replayed over networks."""
    acts = derived.activities(spark, d)
    s = F.col("seq")
    changed = acts.filter(s != 5).select("network_id", F.when(s == 1, "START").otherwise(F.col("activity_id")).alias("activity_id"), F.when(s == 2, F.col("duration") + 5).otherwise(F.col("duration")).alias("duration"))
    return changed.unionByName(acts.select("network_id").distinct().select("network_id", F.lit("EXTRA").alias("activity_id"), F.lit(1.0).alias("duration")))


@query("gr01_built_networks", f"WITH {NETWORKS}, bad AS (SELECT network_id FROM activities WHERE duration > 49) SELECT network_id, count(*) AS activities FROM activities WHERE network_id NOT IN (SELECT network_id FROM bad) GROUP BY network_id")
def built(spark, d):
    """Construction refuses whole networks with an integrity error: here durations above 49 count as negative."""
    from slackline.operators import validate

    acts, deps = nets(spark, d)
    given = acts.withColumn("duration", F.when(F.col("duration") > 49, -F.col("duration")).otherwise(F.col("duration")))
    refused = validate.builder_issues(given, deps).select("network_id").distinct()
    return given.join(refused, "network_id", "left_anti").groupBy("network_id").agg(F.count("*").alias("activities"))


@query("hr04_duration_decisions", f"WITH {DECISIONS}, f AS (SELECT item_id, min_by(CASE decision WHEN 'ACCEPT' THEN 'ACCEPTED' ELSE 'CORRECTED' END, (ts, seq)) AS status, min_by(corrected_value, (ts, seq)) AS v FROM decisions WHERE decision = 'ACCEPT' OR (decision = 'CORRECT' AND corrected_value IS NOT NULL) GROUP BY item_id) SELECT item_id, status, CASE WHEN status = 'CORRECTED' THEN v ELSE 10.0 END AS duration FROM f")
def duration_decisions(spark, d):
    """Durations know no rejection: the first acceptance or correction settles them."""
    log = derived.decisions(spark, d).filter("decision <> 'REJECT'")
    s = review.settled(log)
    return s.select("item_id", "status", F.when(F.col("status") == "CORRECTED", F.col("corrected_value")).otherwise(10.0).alias("duration"))


@query("hr07_corrections", f"{CPM.replace('l_quantity AS duration,', 'CASE WHEN seq = 1 THEN l_quantity + 3 ELSE l_quantity END AS duration,')} SELECT network_id, max(project_duration) AS project_duration FROM cpm GROUP BY network_id")
def corrections(spark, d):
    """Corrected first durations, and the analysis again without any detection."""
    acts, deps = nets(spark, d)
    return schedule.summary(schedule.schedule(acts.withColumn("duration", F.when(F.col("seq") == 1, F.col("duration") + 3).otherwise(F.col("duration"))), deps)).select("network_id", "project_duration")


@query("rp01_report_sections", f"{CPM}, d AS (SELECT network_id, count(*) AS n FROM dependencies GROUP BY ALL), a AS (SELECT network_id, count(*) AS n, count(*) FILTER (is_critical) AS c FROM cpm GROUP BY ALL) SELECT network_id, 'activities' AS section, n AS rows FROM a UNION ALL SELECT network_id, 'dependencies', n FROM d UNION ALL SELECT network_id, 'cpm', c FROM a")
def sections(spark, d):
    acts, deps = nets(spark, d)
    s = report.summary(schedule.schedule(acts, deps), deps)
    cells = s.select("network_id", F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(c).alias("rows")) for n, c in (("activities", "activity_count"), ("dependencies", "dependency_count"), ("cpm", "critical_count"))])).alias("x"))
    return cells.select("network_id", "x.section", "x.rows").filter("rows > 0 or section <> 'dependencies'")


@query("rp03_pert_dashboard", f"{PERT_VARIANCE} SELECT network_id, round(mean, 6) AS expected_duration, round(sqrt(var), 6) AS deviation, 'PERT' AS mode FROM m")
def dashboard(spark, d):
    return pert_totals(spark, d).select("network_id", F.round("project_duration", 6).alias("expected_duration"), F.round("project_deviation", 6).alias("deviation"), F.lit("PERT").alias("mode"))


@query("bm03_markdown_rows", f"WITH {RUNS} SELECT '| ' || image || ' | ' || status || ' | ' || outcome || ' |' AS line FROM o")
def markdown_rows(spark, d):
    return report_sinks.markdown(run_status(spark, d), ["image", "status", "outcome"])


@query("ev23_diagnostics", f"WITH {ACTIVITIES} SELECT network_id, printf('%-8s|%8.2f', activity_id, duration) AS line FROM activities")
def diagnostics(spark, d):
    return derived.activities(spark, d).select("network_id", F.format_string("%-8s|%8.2f", "activity_id", "duration").alias("line"))
