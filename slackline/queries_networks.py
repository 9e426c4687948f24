"""Queries over derived networks, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import numbers
from slackline.operators import graph, schedule, validate
from slackline.plans import derived
from slackline.plans.iterate import cut
from slackline.plans.derived_sql import ACTIVITIES, DIRTY, NETWORKS

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def nets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    acts = derived.activities(spark, d)
    return acts, derived.dependencies(acts)


def dirty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dirty networks, written once: every check reads them."""
    acts, deps = nets(spark, d)
    return cut(derived.dirty_activities(acts)), cut(derived.dirty_dependencies(deps))


#: Earliest finishes, project durations and latest starts by path enumeration; needs activities and dependencies.
PASSES = """fwd AS (
  SELECT network_id, seq, CAST(0 AS DOUBLE) AS es, duration AS ef FROM activities a
  WHERE NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.network_id = a.network_id AND d.t = a.seq)
  UNION ALL SELECT b.network_id, b.seq, f.ef, f.ef + b.duration FROM fwd f JOIN dependencies d ON d.network_id = f.network_id AND d.s = f.seq
  JOIN activities b ON b.network_id = d.network_id AND b.seq = d.t),
early AS (SELECT network_id, seq, max(es) AS es, max(ef) AS ef FROM fwd GROUP BY ALL),
project AS (SELECT network_id, max(ef) AS pd FROM early GROUP BY ALL),
bwd AS (
  SELECT a.network_id, a.seq, p.pd AS lf, p.pd - a.duration AS ls FROM activities a JOIN project p ON p.network_id = a.network_id
  WHERE NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.network_id = a.network_id AND d.s = a.seq)
  UNION ALL SELECT b.network_id, b.seq, f.ls, f.ls - b.duration FROM bwd f JOIN dependencies d ON d.network_id = f.network_id AND d.t = f.seq
  JOIN activities b ON b.network_id = d.network_id AND b.seq = d.s),
late AS (SELECT network_id, seq, min(lf) AS lf, min(ls) AS ls FROM bwd GROUP BY ALL),
cpm AS (
  SELECT a.network_id, a.activity_id, a.seq, a.duration, e.es AS early_start, e.ef AS early_finish, l.ls AS late_start, l.lf AS late_finish,
    l.ls - e.es AS total_float,
    coalesce((SELECT min(x.es) FROM dependencies d JOIN early x ON x.network_id = d.network_id AND x.seq = d.t WHERE d.network_id = a.network_id AND d.s = a.seq) - e.ef, 0) AS free_float,
    abs(l.ls - e.es) < 1e-9 AS is_critical, p.pd AS project_duration
  FROM activities a JOIN early e ON e.network_id = a.network_id AND e.seq = a.seq JOIN late l ON l.network_id = a.network_id AND l.seq = a.seq JOIN project p ON p.network_id = a.network_id)"""
CPM = f"WITH RECURSIVE {NETWORKS}, {PASSES}"
#: The same with three-point means as durations.
PERT_ACTS = f"""{ACTIVITIES.replace("activities AS", "raw AS")}, activities AS (
  SELECT network_id, activity_id, seq, (optimistic_time + 4 * most_likely_time + pessimistic_time) / 6 AS duration,
         ((pessimistic_time - optimistic_time) / 6) * ((pessimistic_time - optimistic_time) / 6) AS variance FROM raw)"""
PERT = f"WITH RECURSIVE {PERT_ACTS}, {NETWORKS.split('activities AS', 1)[1].split('FROM lineitem)),', 1)[1].strip()}, {PASSES}"
#: All walks of the critical subgraph; needs cpm and dependencies.
WALKS = """crit AS (SELECT network_id, seq, activity_id, duration, project_duration FROM cpm WHERE is_critical),
cedge AS (SELECT d.network_id, d.s, d.t FROM dependencies d JOIN crit a ON a.network_id = d.network_id AND a.seq = d.s JOIN crit b ON b.network_id = d.network_id AND b.seq = d.t),
walk AS (
  SELECT network_id, seq, [activity_id] AS path, duration AS total, project_duration FROM crit c
  WHERE NOT EXISTS (SELECT 1 FROM cedge e WHERE e.network_id = c.network_id AND e.t = c.seq)
  UNION ALL SELECT w.network_id, c.seq, list_append(w.path, c.activity_id), w.total + c.duration, w.project_duration
  FROM walk w JOIN cedge e ON e.network_id = w.network_id AND e.s = w.seq JOIN crit c ON c.network_id = e.network_id AND c.seq = e.t),
whole AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM cedge e WHERE e.network_id = w.network_id AND e.s = w.seq))"""


# --- scheduling ---------------------------------------------------------------------------


@query("gr14_cpm_schedule", f"{CPM} SELECT * FROM cpm")
def cpm_schedule(spark, d):
    return schedule.schedule(*nets(spark, d)).select(*schedule.SCHEDULE)


@query("gr08_forward_pass", f"{CPM} SELECT network_id, activity_id, early_start, early_finish FROM cpm")
def forward(spark, d):
    return schedule.schedule(*nets(spark, d)).select("network_id", "activity_id", "early_start", "early_finish")


@query("gr09_backward_pass", f"{CPM} SELECT network_id, activity_id, late_start, late_finish FROM cpm")
def backward(spark, d):
    return schedule.schedule(*nets(spark, d)).select("network_id", "activity_id", "late_start", "late_finish")


@query("gr11_floats", f"{CPM} SELECT network_id, activity_id, total_float, free_float, is_critical FROM cpm")
def floats(spark, d):
    return schedule.schedule(*nets(spark, d)).select("network_id", "activity_id", "total_float", "free_float", "is_critical")


@query("gr22_loop_schedule", f"{CPM} SELECT * FROM cpm")
def loop(spark, d):
    """The join loop, which takes networks of any size."""
    return schedule.loop_schedule(*nets(spark, d))


@query("ag01_project_duration", f"{CPM} SELECT network_id, max(project_duration) AS project_duration, count(*) FILTER (is_critical) AS critical_count, count(*) FILTER (NOT is_critical) AS non_critical_count FROM cpm GROUP BY network_id")
def project_duration(spark, d):
    return schedule.summary(schedule.schedule(*nets(spark, d)))


@query("gr12_critical_paths", f"{CPM}, {WALKS} SELECT network_id, row_number() OVER (PARTITION BY network_id ORDER BY len(path), path) AS path_rank, array_to_string(path, '>') AS path, len(path) AS path_len, total AS path_duration FROM whole WHERE abs(total - project_duration) < 1e-9")
def paths(spark, d):
    return schedule.critical_paths(*nets(spark, d)).select("network_id", "path_rank", F.array_join("path", ">").alias("path"), "path_len", "path_duration")


@query("gr13_critical_walks", f"{CPM}, {WALKS} SELECT network_id, count(*) AS walks, min(array_to_string(path, '>')) AS first_path FROM whole GROUP BY network_id")
def walks(spark, d):
    return schedule.critical_paths(*nets(spark, d), full_length=False).groupBy("network_id").agg(F.count("*").alias("walks"), F.min(F.array_join("path", ">")).alias("first_path"))


@query("st08_critical_edges", f"{CPM}, {WALKS}, steps AS (SELECT network_id, path, unnest(range(1, len(path))) AS i FROM whole WHERE abs(total - project_duration) < 1e-9) SELECT DISTINCT network_id, path[i] AS source, path[i + 1] AS target FROM steps")
def critical_edges(spark, d):
    return schedule.critical_edges(*nets(spark, d))


@query("gr15_critical_path", f"{CPM}, {WALKS}, r AS (SELECT network_id, path, row_number() OVER (PARTITION BY network_id ORDER BY len(path), path) AS k FROM whole WHERE abs(total - project_duration) < 1e-9) SELECT network_id, array_to_string(path, '>') AS path FROM r WHERE k = 1")
def critical_path(spark, d):
    return schedule.critical_paths(*nets(spark, d)).filter("path_rank = 1").select("network_id", F.array_join("path", ">").alias("path"))


# --- three-point estimates ----------------------------------------------------------------


@query("pr05_expected_time", f"WITH {PERT_ACTS} SELECT network_id, activity_id, duration AS expected_time, variance FROM activities")
def expected(spark, d):
    acts = schedule.with_expected_times(derived.activities(spark, d))
    return acts.select("network_id", "activity_id", F.col("duration").alias("expected_time"), "variance")


@query("gr16_pert_schedule", f"{PERT} SELECT network_id, activity_id, early_start, early_finish, late_start, late_finish, round(total_float, 9) AS total_float, is_critical FROM cpm")
def pert(spark, d):
    acts, deps = nets(spark, d)
    out = schedule.schedule(schedule.with_expected_times(acts), deps)
    return out.select("network_id", "activity_id", "early_start", "early_finish", "late_start", "late_finish", F.round("total_float", 9).alias("total_float"), "is_critical")


PERT_VARIANCE = f"""{PERT}, {WALKS}, first AS (SELECT network_id, path FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY len(path), path) AS k FROM whole) WHERE k = 1),
steps AS (SELECT network_id, unnest(path) AS activity_id FROM first), v AS (SELECT s.network_id, sum(a.variance) AS var FROM steps s JOIN activities a ON a.network_id = s.network_id AND a.activity_id = s.activity_id GROUP BY ALL),
m AS (SELECT v.network_id, p.pd AS mean, v.var FROM v JOIN project p ON p.network_id = v.network_id)"""


def pert_totals(spark, d):
    acts, deps = nets(spark, d)
    acts = schedule.with_expected_times(acts)
    return schedule.first_walk_totals(acts, deps)


@query("ag04_project_variance", f"{PERT_VARIANCE} SELECT network_id, round(mean, 9) AS project_duration, round(var, 6) AS project_variance, round(sqrt(var), 6) AS project_deviation FROM m")
def project_variance(spark, d):
    return pert_totals(spark, d).select("network_id", F.round("project_duration", 9).alias("project_duration"), F.round("project_variance", 6).alias("project_variance"), F.round("project_deviation", 6).alias("project_deviation"))


@query(
    "pr26_completion_probability",
    f"""{PERT_VARIANCE}, z AS (SELECT network_id, (mean * 1.1 - mean) / sqrt(var) AS z FROM m WHERE var > 0),
    term(network_id, x, n, term, total) AS (SELECT network_id, abs(z) / sqrt(2), 0, abs(z) / sqrt(2), abs(z) / sqrt(2) FROM z
      UNION ALL SELECT network_id, x, n + 1, term * 2 * x * x / (2 * (n + 1) + 1), total + term * 2 * x * x / (2 * (n + 1) + 1) FROM term WHERE n < 120),
    erf AS (SELECT network_id, x, CASE WHEN x > 6 THEN 1 ELSE least(1, 2 / sqrt(pi()) * exp(-x * x) * total) END AS e FROM term WHERE n = 120)
    SELECT z.network_id, round(CASE WHEN z.z >= 0 THEN 0.5 + e / 2 ELSE 0.5 - e / 2 END, 6) AS probability FROM z JOIN erf ON erf.network_id = z.network_id""",
)
def probability(spark, d):
    """Chance to finish within 110 % of the expected duration."""
    t = pert_totals(spark, d).filter("project_variance > 0")
    mean = F.col("project_duration")
    return t.select("network_id", F.round(numbers.completion_probability(mean * 1.1, mean, F.col("project_deviation")), 6).alias("probability"))


@query(
    "va07_pert_validation",
    f"""WITH {ACTIVITIES}, e AS (SELECT network_id, activity_id, CASE WHEN network_id % 61 = 0 AND seq = 1 THEN NULL WHEN network_id % 59 = 0 AND seq = 2 THEN -1.0 ELSE optimistic_time END AS o,
      CASE WHEN network_id % 53 = 0 AND seq = 1 THEN 0.25 ELSE most_likely_time END AS m, pessimistic_time AS p FROM activities),
    i AS (SELECT network_id, 'pert_estimate_invalid' AS code, activity_id FROM e WHERE o < 0 UNION ALL SELECT network_id, 'pert_estimate_invalid', activity_id FROM e WHERE m < 0
      UNION ALL SELECT network_id, 'missing_pert_estimate', activity_id FROM e WHERE o IS NULL OR m IS NULL OR p IS NULL
      UNION ALL SELECT network_id, 'pert_ordering', activity_id FROM e WHERE o >= 0 AND m >= 0 AND o > m UNION ALL SELECT network_id, 'pert_ordering', activity_id FROM e WHERE m >= 0 AND m > p
      UNION ALL SELECT network_id, 'pert_ordering', activity_id FROM e WHERE o >= 0 AND o > p)
    SELECT network_id, code, activity_id, count(*) AS n FROM i GROUP BY ALL""",
)
def pert_validation(spark, d):
    return validate.pert_issues(dirty_estimates(spark, d)).groupBy("network_id", "code", "activity_id").agg(F.count("*").alias("n"))


def dirty_estimates(spark, d):
    k, s = F.col("network_id"), F.col("seq")
    acts = derived.activities(spark, d)
    return acts.withColumn("optimistic_time", F.when((k % 61 == 0) & (s == 1), None).when((k % 59 == 0) & (s == 2), -1.0).otherwise(F.col("optimistic_time"))).withColumn(
        "most_likely_time", F.when((k % 53 == 0) & (s == 1), 0.25).otherwise(F.col("most_likely_time"))
    )


@query(
    "va08_pert_status",
    f"""WITH {ACTIVITIES}, e AS (SELECT network_id, activity_id, CASE WHEN network_id % 61 = 0 AND seq = 1 THEN NULL WHEN network_id % 59 = 0 AND seq = 2 THEN -1.0 ELSE optimistic_time END AS o,
      CASE WHEN network_id % 53 = 0 AND seq = 1 THEN 0.25 ELSE most_likely_time END AS m, pessimistic_time AS p FROM activities),
    f AS (SELECT network_id, coalesce(o < 0, false) OR coalesce(m < 0, false) OR coalesce(o >= 0 AND m >= 0 AND o > m, false) OR coalesce(m > p, false) OR coalesce(o >= 0 AND o > p, false) AS bad, o IS NULL OR m IS NULL OR p IS NULL AS missing FROM e)
    SELECT network_id, CASE WHEN bool_or(bad) THEN 'PERT_INVALID' WHEN bool_or(missing) THEN 'PERT_REVIEW_REQUIRED' ELSE 'PERT_READY' END AS status FROM f GROUP BY network_id""",
)
def pert_status(spark, d):
    return validate.pert_status(dirty_estimates(spark, d))


# --- graph algebra ------------------------------------------------------------------------


@query("jn01_edges", f"WITH {NETWORKS} SELECT network_id, source, target FROM dependencies")
def edges(spark, d):
    acts, deps = nets(spark, d)
    return graph.known_edges(acts, deps)


@query("jn02_dangling", f"WITH {DIRTY} SELECT d.network_id, d.source, d.target FROM dirty_dependencies d WHERE NOT EXISTS (SELECT 1 FROM dirty_activities a WHERE a.network_id = d.network_id AND a.activity_id = d.source) OR NOT EXISTS (SELECT 1 FROM dirty_activities a WHERE a.network_id = d.network_id AND a.activity_id = d.target)")
def dangling(spark, d):
    return graph.dangling_edges(*dirty(spark, d))


@query("gr04_adjacency", f"WITH {NETWORKS}, s AS (SELECT network_id, source AS activity_id, string_agg(target, ' ' ORDER BY target) AS successors FROM dependencies GROUP BY ALL), p AS (SELECT network_id, target AS activity_id, string_agg(source, ' ' ORDER BY source) AS predecessors FROM dependencies GROUP BY ALL) SELECT a.network_id, a.activity_id, coalesce(p.predecessors, '') AS predecessors, coalesce(s.successors, '') AS successors FROM activities a LEFT JOIN s USING (network_id, activity_id) LEFT JOIN p USING (network_id, activity_id)")
def adjacency(spark, d):
    out = graph.adjacency(*nets(spark, d))
    return out.select("network_id", "activity_id", F.array_join("predecessors", " ").alias("predecessors"), F.array_join("successors", " ").alias("successors"))


LEVELS = f"""WITH RECURSIVE {NETWORKS}, lv AS (SELECT network_id, seq, 0 AS level FROM activities a WHERE NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.network_id = a.network_id AND d.t = a.seq)
  UNION ALL SELECT lv.network_id, d.t, lv.level + 1 FROM lv JOIN dependencies d ON d.network_id = lv.network_id AND d.s = lv.seq), levels AS (SELECT network_id, seq, max(level) AS level FROM lv GROUP BY ALL)"""


@query("gr07_levels", f"{LEVELS} SELECT a.network_id, a.activity_id, l.level FROM activities a JOIN levels l USING (network_id, seq)")
def levels(spark, d):
    return graph.levels(*nets(spark, d)).select("network_id", "activity_id", "level")


@query("gr19_layout", f"{LEVELS} SELECT a.network_id, a.activity_id, l.level, row_number() OVER (PARTITION BY a.network_id, l.level ORDER BY a.activity_id) - 1 AS row_index, CAST(40 + l.level * (132 + 72) AS DOUBLE) AS x, CAST(40 + (row_number() OVER (PARTITION BY a.network_id, l.level ORDER BY a.activity_id) - 1) * (68 + 28) AS DOUBLE) AS y FROM activities a JOIN levels l USING (network_id, seq)")
def layout(spark, d):
    return graph.layout(graph.levels(*nets(spark, d)))


@query("gr20_edge_points", f"{LEVELS}, p AS (SELECT a.network_id, a.activity_id, CAST(40 + l.level * 204 AS DOUBLE) AS x, CAST(40 + (row_number() OVER (PARTITION BY a.network_id, l.level ORDER BY a.activity_id) - 1) * 96 AS DOUBLE) AS y FROM activities a JOIN levels l USING (network_id, seq)) SELECT d.network_id, d.source, d.target, s.x + 132 AS x1, s.y + 34 AS y1, t.x AS x2, t.y + 34 AS y2 FROM dependencies d JOIN p s ON s.network_id = d.network_id AND s.activity_id = d.source JOIN p t ON t.network_id = d.network_id AND t.activity_id = d.target")
def edge_points(spark, d):
    acts, deps = nets(spark, d)
    return graph.edge_points(graph.layout(graph.levels(acts, deps)), deps)


@query("so01_topological_order", f"{LEVELS} SELECT a.network_id, row_number() OVER (PARTITION BY a.network_id ORDER BY l.level, a.seq) AS place, a.activity_id FROM activities a JOIN levels l USING (network_id, seq)")
def topological(spark, d):
    rows = graph.levels(*nets(spark, d))
    return rows.select("network_id", F.row_number().over(W.partitionBy("network_id").orderBy("level", "seq")).alias("place"), "activity_id")


@query("ag26_sources_sinks", f"WITH {NETWORKS} SELECT network_id, activity_id, NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.network_id = a.network_id AND d.target = a.activity_id) AS is_source, NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.network_id = a.network_id AND d.source = a.activity_id) AS is_sink FROM activities a")
def ends(spark, d):
    return graph.ends(*nets(spark, d))


@query("ag20_degrees", f"WITH {NETWORKS} SELECT a.network_id, a.activity_id, (SELECT count(*) FROM dependencies d WHERE d.network_id = a.network_id AND d.target = a.activity_id) AS in_degree, (SELECT count(*) FROM dependencies d WHERE d.network_id = a.network_id AND d.source = a.activity_id) AS out_degree FROM activities a")
def degrees(spark, d):
    return graph.degrees(*nets(spark, d))


@query(
    "gr18_all_paths",
    f"""WITH RECURSIVE {NETWORKS}, n AS (SELECT network_id, max(seq) AS last FROM activities GROUP BY ALL), p AS (SELECT network_id, seq, [activity_id] AS path FROM activities WHERE seq = 1
    UNION ALL SELECT p.network_id, d.t, list_append(p.path, d.target) FROM p JOIN dependencies d ON d.network_id = p.network_id AND d.s = p.seq)
    SELECT p.network_id, array_to_string(p.path, '>') AS path FROM p JOIN n ON n.network_id = p.network_id AND n.last = p.seq""",
)
def all_paths(spark, d):
    """All paths from the first to the last activity of each network."""
    acts, deps = nets(spark, d)
    ends = acts.groupBy("network_id").agg(F.min_by("activity_id", "seq").alias("source"), F.max_by("activity_id", "seq").alias("target"))
    return graph.simple_paths(acts, deps, ends).select("network_id", F.array_join("path", ">").alias("path"))


@query(
    "gr10_components",
    f"""WITH RECURSIVE {NETWORKS}, cut AS (SELECT * FROM dependencies WHERE s % 4 <> 0 AND t % 4 <> 0), both_ways AS (SELECT network_id, s, t FROM cut UNION SELECT network_id, t, s FROM cut),
    reach(network_id, s, t) AS (SELECT network_id, seq, seq FROM activities UNION SELECT r.network_id, r.s, b.t FROM reach r JOIN both_ways b ON b.network_id = r.network_id AND b.s = r.t)
    SELECT r.network_id, a.activity_id, 'N' || lpad(CAST(min(r.t) AS VARCHAR), 2, '0') AS component FROM reach r JOIN activities a ON a.network_id = r.network_id AND a.seq = r.s GROUP BY ALL""",
)
def components(spark, d):
    """Undirected components once every fourth activity has lost its edges."""
    acts, deps = nets(spark, d)
    apart = (F.substring("source", 2, 2).cast("int") % 4 != 0) & (F.substring("target", 2, 2).cast("int") % 4 != 0)
    return graph.components(acts, deps.filter(apart)).select("network_id", "activity_id", "component")


#: Reachability along edges whose ends are activities; an activity lies on a cycle when it reaches itself.
FORTH = f"""{DIRTY}, known AS (SELECT DISTINCT d.network_id, d.source, d.target FROM dirty_dependencies d JOIN activities a ON a.network_id = d.network_id AND a.activity_id = d.source JOIN activities b ON b.network_id = d.network_id AND b.activity_id = d.target),
onward(network_id, s, t) AS (SELECT network_id, source, target FROM known UNION SELECT o.network_id, o.s, k.target FROM onward o JOIN known k ON k.network_id = o.network_id AND k.source = o.t)"""


@query("gr06_cycles", f"WITH RECURSIVE {FORTH} SELECT network_id, network_id NOT IN (SELECT network_id FROM onward WHERE s = t) AS is_dag FROM (SELECT DISTINCT network_id FROM activities) a")
def cycles(spark, d):
    acts, deps = nets(spark, d)
    return graph.acyclic(acts, derived.dirty_dependencies(deps))


@query(
    "gr06_example_cycles",
    f"""WITH RECURSIVE {FORTH}, on_cycle AS (SELECT network_id, min(s) AS start FROM onward WHERE s = t GROUP BY network_id),
    chain(network_id, start, place, path) AS (SELECT k.network_id, c.start, k.target, [k.source] FROM known k JOIN on_cycle c ON c.network_id = k.network_id AND c.start = k.source
      UNION ALL SELECT c.network_id, c.start, k.target, list_append(c.path, k.source) FROM chain c JOIN known k ON k.network_id = c.network_id AND k.source = c.place WHERE c.place <> c.start AND NOT list_contains(c.path, c.place)),
    r AS (SELECT network_id, path, row_number() OVER (PARTITION BY network_id ORDER BY len(path), path) AS k FROM chain WHERE place = start)
    SELECT network_id, array_to_string(path, '>') AS cycle FROM r WHERE k = 1""",
)
def example_cycles(spark, d):
    acts, deps = nets(spark, d)
    return graph.example_cycles(acts, derived.dirty_dependencies(deps)).select("network_id", F.array_join("cycle", ">").alias("cycle"))


@query("gr03_remove_vertex", f"WITH {NETWORKS} SELECT network_id, source, target FROM dependencies WHERE source <> 'N02' AND target <> 'N02'")
def remove_vertex(spark, d):
    acts, deps = nets(spark, d)
    gone = acts.filter("activity_id = 'N02'").select("network_id", "activity_id")
    return graph.remove_activities(acts, deps, gone)[1].select("network_id", "source", "target")


@query("gr21_pure_critical_paths", f"{CPM}, {WALKS} SELECT network_id, array_to_string(path, '>') AS path FROM whole WHERE abs(total - project_duration) < 1e-6")
def pure_paths(spark, d):
    return schedule.critical_paths(*nets(spark, d), tolerance=1e-6).select("network_id", F.array_join("path", ">").alias("path"))


@query("ag27_counts", f"WITH {NETWORKS}, a AS (SELECT network_id, count(*) AS activity_count, string_agg(activity_id, ' ' ORDER BY seq) AS activity_ids FROM activities GROUP BY ALL), d AS (SELECT network_id, count(*) AS dependency_count FROM dependencies GROUP BY ALL) SELECT a.network_id, a.activity_count, coalesce(d.dependency_count, 0) AS dependency_count, a.activity_ids FROM a LEFT JOIN d USING (network_id)")
def counts(spark, d):
    return graph.counts(*nets(spark, d)).withColumn("activity_ids", F.array_join("activity_ids", " "))


# --- validation ---------------------------------------------------------------------------

#: Kahn's peel as reachability: an activity lies on a cycle when it reaches itself.
VALIDATION = f"""WITH RECURSIVE {DIRTY}, ids AS (SELECT DISTINCT network_id, activity_id FROM dirty_activities),
good AS (SELECT d.* FROM dirty_dependencies d JOIN ids a ON a.network_id = d.network_id AND a.activity_id = d.source JOIN ids b ON b.network_id = d.network_id AND b.activity_id = d.target),
both_ways AS (SELECT network_id, source, target FROM good UNION SELECT network_id, target, source FROM good),
reach(network_id, s, t) AS (SELECT network_id, activity_id, activity_id FROM ids UNION SELECT r.network_id, r.s, b.target FROM reach r JOIN both_ways b ON b.network_id = r.network_id AND b.source = r.t),
comp AS (SELECT network_id, count(DISTINCT m) AS n FROM (SELECT network_id, s, min(t) AS m FROM reach GROUP BY ALL) GROUP BY ALL),
forth(network_id, s, t) AS (SELECT network_id, source, target FROM good UNION SELECT f.network_id, f.s, g.target FROM forth f JOIN good g ON g.network_id = f.network_id AND g.source = f.t),
issues AS (
  SELECT network_id, 'missing_activity_id' AS code, activity_id AS element FROM dirty_activities WHERE trim(activity_id) = ''
  UNION ALL SELECT network_id, 'missing_duration', activity_id FROM dirty_activities WHERE coalesce(duration, 0) <= 0
  UNION ALL SELECT network_id, 'unknown_dependency_source', source FROM dirty_dependencies d WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.network_id = d.network_id AND i.activity_id = d.source)
  UNION ALL SELECT network_id, 'unknown_dependency_target', target FROM dirty_dependencies d WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.network_id = d.network_id AND i.activity_id = d.target)
  UNION ALL SELECT network_id, 'self_loop', source FROM dirty_dependencies WHERE source = target
  UNION ALL SELECT network_id, 'duplicate_edge', source || '->' || target FROM (SELECT network_id, source, target, row_number() OVER (PARTITION BY network_id, source, target) AS k FROM dirty_dependencies) WHERE k > 1
  UNION ALL SELECT DISTINCT network_id, 'cycle', '' FROM forth WHERE s = t
  UNION ALL SELECT network_id, 'disconnected_components', CAST(n AS VARCHAR) FROM comp WHERE n > 1
  UNION ALL SELECT network_id, 'isolated_activity', activity_id FROM dirty_activities a WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.network_id = a.network_id AND (g.source = a.activity_id OR g.target = a.activity_id)))"""


@query("va02_graph_issues", f"{VALIDATION} SELECT network_id, code, element, count(*) AS n FROM issues GROUP BY ALL")
def graph_issues(spark, d):
    return validate.graph_issues(*dirty(spark, d)).groupBy("network_id", "code", "element").agg(F.count("*").alias("n"))


@query("va03_graph_status", f"{VALIDATION} SELECT a.network_id, CASE WHEN i.n IS NULL THEN 'VALID' ELSE 'INVALID' END AS status, coalesce(i.n, 0) AS issue_count FROM (SELECT DISTINCT network_id FROM dirty_activities) a LEFT JOIN (SELECT network_id, count(*) AS n FROM issues GROUP BY ALL) i USING (network_id)")
def graph_status(spark, d):
    return validate.graph_status(*dirty(spark, d))


@query("va05_cpm_gate", f"{CPM}, ok AS (SELECT network_id FROM activities GROUP BY network_id HAVING count(*) > 1) SELECT network_id, max(project_duration) AS project_duration FROM cpm WHERE network_id IN (SELECT network_id FROM ok) GROUP BY network_id")
def cpm_gate(spark, d):
    """Schedules only of networks that pass every check; a single activity is isolated and does not."""
    acts, deps = nets(spark, d)
    valid = validate.graph_status(acts, deps).filter("status = 'VALID'").select("network_id")
    return schedule.summary(schedule.schedule(acts.join(valid, "network_id", "left_semi"), deps)).select("network_id", "project_duration")


@query(
    "va04_first_error",
    f"""{VALIDATION}, counted AS (SELECT network_id, activity_id, count(*) AS n FROM dirty_activities GROUP BY ALL),
    e AS (SELECT network_id, 2 AS rank, 'missing_duration' AS code FROM dirty_activities WHERE duration IS NULL OR duration <= 0
      UNION ALL SELECT network_id, 3, 'duplicate_activity' FROM counted WHERE n > 1
      UNION ALL SELECT d.network_id, 4, 'missing_reference' FROM dirty_dependencies d WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.network_id = d.network_id AND i.activity_id = d.source) OR NOT EXISTS (SELECT 1 FROM ids i WHERE i.network_id = d.network_id AND i.activity_id = d.target)
      UNION ALL SELECT DISTINCT network_id, 5, 'cycle' FROM forth WHERE s = t)
    SELECT network_id, min_by(code, rank) AS code FROM e GROUP BY network_id""",
)
def first_error(spark, d):
    return validate.first_error(*dirty(spark, d))


@query("va01_builder_checks", f"WITH {DIRTY} SELECT network_id, code, count(*) AS n FROM (SELECT network_id, 'self_dependency' AS code FROM dirty_dependencies WHERE source = target UNION ALL SELECT network_id, 'duplicate_dependency' FROM (SELECT network_id, row_number() OVER (PARTITION BY network_id, source, target) AS k FROM dirty_dependencies) WHERE k > 1 UNION ALL SELECT network_id, 'invalid_duration' FROM dirty_activities WHERE duration <= 0 UNION ALL SELECT d.network_id, 'missing_reference' FROM dirty_dependencies d WHERE NOT EXISTS (SELECT 1 FROM dirty_activities a WHERE a.network_id = d.network_id AND a.activity_id = d.source) OR NOT EXISTS (SELECT 1 FROM dirty_activities a WHERE a.network_id = d.network_id AND a.activity_id = d.target)) GROUP BY ALL")
def builder_checks(spark, d):
    return validate.builder_issues(*dirty(spark, d)).groupBy("network_id", "code").agg(F.count("*").alias("n"))


@query(
    "va13_consistency",
    f"""{VALIDATION}, f AS (SELECT network_id, count(*) FILTER (code = 'self_loop') AS loops, count(*) FILTER (code = 'duplicate_edge') AS twice, count(*) FILTER (code = 'cycle') AS cycles, count(*) FILTER (code = 'isolated_activity') AS alone FROM issues GROUP BY ALL)
    SELECT a.network_id, CASE WHEN loops > 0 THEN 'self_loop' WHEN twice > 0 THEN 'duplicate' WHEN cycles > 0 THEN 'cycle' WHEN alone > 0 THEN 'isolated' ELSE 'valid' END AS consistency FROM (SELECT DISTINCT network_id FROM dirty_activities) a LEFT JOIN f USING (network_id)""",
)
def consistency(spark, d):
    acts, deps = dirty(spark, d)
    return validate.consistency(acts, validate.graph_issues(acts, deps))
