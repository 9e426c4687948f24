"""Queries over files, projects, bulk construction and settings, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.operators import construct, report
from slackline.plans import derived, settings
from slackline.plans.derived_sql import ACTIVITIES, NETWORKS
from slackline.queries_networks import CPM, nets
from slackline.sources import annotations, csv_networks, images, json_networks

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- CSV ----------------------------------------------------------------------------------


def csv_texts(spark, d):
    """A CSV for each network: three kinds of headers, quoted names, a blank id in every 53rd, an unreadable duration in every 59th, no duration column in every 61st."""
    acts, deps = nets(spark, d)
    rows = csv_networks.export_rows(acts, deps).join(acts.select("network_id", "activity_id", "seq"), ["network_id", "activity_id"])
    k = F.col("network_id")
    kind = (k % 3).cast("int")
    header = F.when(k % 61 == 0, "activity_id,name,predecessors").when(kind == 0, "﻿activity_id,name,duration,predecessors,optimistic_time,pessimistic_time").when(kind == 1, " Activity_ID ,Name,DUR,Predecessors,optimistic_time,pessimistic_time").otherwise("predecessors,time,activity_id")
    own = F.when((k % 53 == 0) & (F.col("seq") == 2), "").otherwise(F.col("activity_id"))
    duration = F.when((k % 59 == 0) & (F.col("seq") == 1), "x1").otherwise(F.col("duration"))
    name = F.concat(F.lit('"Task ""'), "activity_id", F.lit('"", first"'))
    before = F.concat(F.lit('"'), F.regexp_replace(F.coalesce("predecessors", F.lit("")), " ", ", "), F.lit('"'))
    full = F.concat_ws(",", own, name, duration, before, "optimistic_time", "pessimistic_time")
    line = F.when(k % 61 == 0, F.concat_ws(",", own, name, before)).when(kind == 2, F.concat_ws(",", before, duration, own)).otherwise(full)
    lines = rows.groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    end = F.when(k % 2 == 0, "\r\n").otherwise("\n")
    return lines.select("network_id", F.concat(header, end, F.array_join(F.col("l.line"), "\n"), end, end).alias("csv"))


CSV = f"""WITH {NETWORKS}, failed AS (SELECT DISTINCT network_id FROM activities WHERE (network_id % 53 = 0 AND seq = 2) OR network_id % 59 = 0 OR network_id % 61 = 0)"""


@query("sc01_csv_activities", f"""{CSV} SELECT network_id, seq + 1 AS row_number, activity_id, CASE WHEN network_id % 3 = 2 THEN activity_id ELSE 'Task "' || activity_id || '", first' END AS name, duration, CASE WHEN network_id % 3 <> 2 THEN optimistic_time END AS optimistic_time FROM activities WHERE network_id NOT IN (SELECT network_id FROM failed)""")
def csv_activities(spark, d):
    return csv_networks.parse_texts(csv_texts(spark, d))[0].select("network_id", "row_number", "activity_id", "name", "duration", "optimistic_time")


@query("sc02_csv_dependencies", f"{CSV} SELECT network_id, source, target FROM dependencies WHERE network_id NOT IN (SELECT network_id FROM failed)")
def csv_dependencies(spark, d):
    return csv_networks.parse_texts(csv_texts(spark, d))[1]


@query("sc03_csv_errors", f"{CSV} SELECT network_id, CAST(seq + 1 AS INTEGER) AS row_number, 'missing_activity_id' AS code, NULL AS value FROM activities WHERE network_id % 53 = 0 AND network_id % 61 <> 0 AND seq = 2 UNION ALL SELECT network_id, CAST(seq + 1 AS INTEGER), 'invalid_duration', 'x1' FROM activities WHERE network_id % 59 = 0 AND network_id % 61 <> 0 AND seq = 1 UNION ALL SELECT DISTINCT network_id, CAST(NULL AS INTEGER), 'missing_column:duration', NULL FROM activities WHERE network_id % 61 = 0")
def csv_errors(spark, d):
    return csv_networks.parse_texts(csv_texts(spark, d))[2]


# --- projects and legacy annotations -------------------------------------------------------


def project_documents(spark, d):
    acts, deps = nets(spark, d)
    k = F.col("o_orderkey")
    projects = derived.read(spark, d, "orders").select(k.alias("network_id"), k.cast("string").alias("project_id"), F.when(k % 5 != 0, F.concat(F.lit("Project "), k.cast("string"))).alias("name"), F.when(k % 4 == 0, "review").alias("status"))
    documents = json_networks.projects_to_json(projects, acts, deps)
    return documents.withColumn("json", F.when(F.col("network_id") % 11 == 0, '{"version": "1.0"}').otherwise(F.col("json")))


@query("sc10_projects", f"WITH {NETWORKS}, a AS (SELECT network_id, count(*) AS n FROM activities GROUP BY ALL), e AS (SELECT network_id, count(*) AS n FROM dependencies GROUP BY ALL) SELECT o_orderkey AS network_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS project_id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN 'Untitled Project' ELSE 'Project ' || CAST(o_orderkey AS VARCHAR) END AS name, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 4 = 0 THEN 'review' ELSE 'draft' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'project_info' END AS error, CASE WHEN o_orderkey % 11 <> 0 THEN a.n END AS activities, CASE WHEN o_orderkey % 11 <> 0 AND a.n IS NOT NULL THEN coalesce(e.n, 0) END AS dependencies FROM orders LEFT JOIN a ON a.network_id = o_orderkey LEFT JOIN e ON e.network_id = o_orderkey")
def projects(spark, d):
    """Project documents written and read back: fields with defaults, and the sizes of their graphs."""
    parsed = json_networks.parse_projects(project_documents(spark, d))
    graphs = json_networks.project_graphs(parsed).select("network_id", F.size("g.activities").cast("long").alias("activities"), F.size("g.dependencies").cast("long").alias("dependencies"))
    return parsed.join(graphs, "network_id", "left").select("network_id", "project_id", "name", "status", "error", "activities", "dependencies")


def legacy_documents(spark, d):
    """Annotations of the older form: activities as a map or a list, durations inside them or at the top, three ways to write edges; some broken."""
    acts, deps = nets(spark, d)
    k = F.col("network_id")
    entry = F.to_json(F.struct(F.col("activity_id").alias("id"), F.when(k % 3 != 1, F.col("duration")).alias("duration"), F.array(F.col("seq") * 10.0, F.col("seq") * 5.0).alias("position")))
    a = acts.groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("seq", "activity_id", "duration", entry.alias("entry")))).alias("a"))
    pair = lambda s, t: F.to_json(F.struct(F.col("source").alias(s), F.col("target").alias(t)))
    edge = F.when(k % 3 == 0, F.to_json(F.array("source", "target"))).when(k % 3 == 1, pair("source", "target")).otherwise(pair("source_id", "target_id"))
    e = deps.groupBy("network_id").agg(F.array_sort(F.collect_list(edge)).alias("e"))
    rows = a.join(e, "network_id", "left")
    listed = F.concat(F.lit("["), F.array_join("a.entry", ","), F.lit("]"))
    mapped = F.concat(F.lit("{"), F.array_join(F.transform("a", lambda x: F.concat(F.lit('"'), x["activity_id"], F.lit('":'), x["entry"])), ","), F.lit("}"))
    durations = F.concat(F.lit(',"durations":{'), F.array_join(F.transform("a", lambda x: F.concat(F.lit('"'), x["activity_id"], F.lit('":'), x["duration"].cast("string"))), ","), F.lit("}"))
    edges = F.when(k % 67 == 0, '[["only one"]]').otherwise(F.concat(F.lit("["), F.array_join(F.coalesce("e", F.array().cast("array<string>")), ","), F.lit("]")))
    body = F.concat(F.lit('{"diagram_type":"aon","activities":'), F.when(k % 2 == 0, listed).otherwise(mapped), F.when(k % 3 == 1, durations).otherwise(""), F.lit(',"dependencies":'), edges, F.lit("}"))
    return rows.select(k.cast("string").alias("image_key"), F.when(k % 71 == 0, "[1, 2]").when(k % 73 == 0, '{"diagram_type":"aon"}').otherwise(body).alias("json"))


LEGACY_ERROR = "CASE WHEN network_id % 71 = 0 THEN 'not an object' WHEN network_id % 73 = 0 OR network_id % 67 = 0 THEN 'dependencies' END"


@query("sc13_legacy_annotations", f"WITH {NETWORKS}, s AS (SELECT network_id, count(*) AS n, sum(duration) AS total, max(seq) * 10.0 AS reach FROM activities GROUP BY ALL), e AS (SELECT network_id, count(*) AS n FROM dependencies GROUP BY ALL), r AS (SELECT s.network_id, {LEGACY_ERROR.replace('network_id', 's.network_id')} AS error, s.n, s.total, s.reach, coalesce(e.n, 0) AS edges FROM s LEFT JOIN e ON e.network_id = s.network_id) SELECT CAST(network_id AS VARCHAR) AS image_key, error, CASE WHEN error IS NULL THEN 'AON' END AS diagram_type, CASE WHEN error IS NULL THEN n END AS activities, CASE WHEN error IS NULL THEN round(total, 6) END AS duration, CASE WHEN error IS NULL THEN CAST(reach AS DOUBLE) END AS reach, CASE WHEN error IS NULL THEN edges END AS edges FROM r")
def legacy_annotations(spark, d):
    rows = annotations.parse_legacy(legacy_documents(spark, d))
    total = F.round(F.aggregate("activities", F.lit(0.0), lambda n, a: n + a["duration"]), 6)
    known = F.col("error").isNull()
    return rows.select("image_key", "error", "diagram_type", F.when(known, F.size("activities").cast("long")).alias("activities"), total.alias("duration"), F.array_max(F.transform("activities", lambda a: a["position"][0])).alias("reach"), F.when(known, F.size("edges").cast("long")).alias("edges"))


def annotation_documents(spark, d):
    """Annotations of version 1.0: edges in three ways, one of them uncertain, boxes instead of positions for even places, one uncertain activity."""
    acts, deps = nets(spark, d)
    k, s = F.col("network_id"), F.col("seq")
    box = F.when(s % 2 == 0, F.array(s * 10.0, s * 5.0, F.lit(4.0), F.lit(2.0)))
    entry = F.struct(F.col("activity_id").alias("id"), "duration", F.when(s % 2 == 1, F.array(s * 10.0, s * 5.0)).alias("position"), F.when(k % 2 == 0, box).alias("bbox"), F.when(k % 2 == 1, box).alias("bounding_box"))
    a = acts.groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(entry).alias("e")))).alias("a"))
    pair = lambda x, y: F.to_json(F.struct(F.col("source").alias(x), F.col("target").alias(y)))
    edge = F.when(k % 3 == 0, F.to_json(F.array("source", "target"))).when(k % 3 == 1, pair("source", "target")).otherwise(pair("source_id", "target_id"))
    e = deps.groupBy("network_id").agg(F.array_sort(F.collect_list(edge)).alias("e"))
    joined = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    edges = joined(F.coalesce("e", F.array().cast("array<string>")))
    doc = F.concat(F.lit('{"schema_version":"1.0","annotation_status":"COMPLETE","activities":'), joined(F.col("a.e")), F.lit(',"dependencies":'), edges, F.lit(',"uncertain":{"activities":["N03"],"events":[],"dependencies":["[\\"N01\\",\\"N02\\"]"]}}'))
    return a.join(e, "network_id", "left").select(k.cast("string").alias("image_key"), doc.alias("json"))


@query("sc12_annotation_activities", f"WITH {ACTIVITIES} SELECT CAST(network_id AS VARCHAR) AS image_key, activity_id AS id, duration, CASE WHEN seq % 2 = 1 THEN seq * 10.0 ELSE seq * 10.0 + 2 END::DOUBLE AS cx, CASE WHEN seq % 2 = 1 THEN seq * 5.0 ELSE seq * 5.0 + 1 END::DOUBLE AS cy FROM activities WHERE activity_id <> 'N03'")
def annotation_activities(spark, d):
    rows = annotations.activities(annotations.parse(annotation_documents(spark, d)))
    return rows.select("image_key", "id", "duration", F.get("center", 0).alias("cx"), F.get("center", 1).alias("cy"))


@query("sc12_annotation_edges", f"WITH {NETWORKS} SELECT CAST(network_id AS VARCHAR) AS image_key, source, target FROM dependencies WHERE NOT (source = 'N01' AND target = 'N02')")
def annotation_edges(spark, d):
    return annotations.edges(annotations.parse(annotation_documents(spark, d))).select("image_key", "source", "target")


@query("sc20_image_checks", """WITH i AS (SELECT p_partkey, p_size * 450 - 400 AS w, (p_partkey * 7) % 300 AS h FROM part), b AS (SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 5 <> 4 THEN ['png', 'gif', 'bmp', 'jpeg'][CAST(p_partkey % 5 + 1 AS INTEGER)] END AS format, CASE WHEN p_partkey % 5 <> 4 THEN greatest(w, 0) END AS width, CASE WHEN p_partkey % 5 <> 4 THEN h END AS height FROM i)
SELECT path, format, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CASE WHEN width IS NULL THEN 'unreadable' WHEN least(width, height) = 0 THEN 'zero dimension' WHEN least(width, height) < 10 THEN 'too small' WHEN greatest(width, height) > 20000 THEN 'too large' END AS problem FROM b""")
def image_checks(spark, d):
    """Headers of four formats, and bytes of none, for each part."""
    k = F.col("p_partkey")
    rows = derived.read(spark, d, "part").select(k, F.greatest(F.col("p_size") * 450 - 400, F.lit(0)).cast("int").alias("w"), ((k * 7) % 300).cast("int").alias("h"))
    big = lambda c, n: F.lpad(F.hex(F.col(c)), n, "0")
    little = lambda c, n: F.concat(*[F.substring(big(c, n), n - 1 - 2 * i, 2) for i in range(n // 2)])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big("w", 8), big("h", 8))
    gif = F.concat(F.lit("474946383961"), little("w", 4), little("h", 4))
    bmp = F.concat(F.lit("424D" + "00" * 16), little("w", 8), little("h", 8))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), big("h", 4), big("w", 4))
    kind = k % 5
    content = F.unhex(F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, bmp).when(kind == 3, jpeg).otherwise("0102"))
    return images.checked(rows.select(k.cast("string").alias("path"), content.alias("content")))


# --- bulk construction --------------------------------------------------------------------


def nested(spark, d):
    """Networks as nested rows; durations above 49 turn negative, every 37th network has an edge to no activity, every 41st has none at all."""
    acts, deps = nets(spark, d)
    k = F.col("network_id")
    given = F.when(F.col("duration") > 49, -F.col("duration")).otherwise(F.col("duration"))
    a = acts.groupBy("network_id").agg(F.expr("transform(array_sort(collect_list(struct(seq, activity_id, duration))), x -> named_struct('activity_id', x.activity_id, 'duration', if(x.duration > 49, -x.duration, x.duration)))").alias("activities"))
    e = deps.groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("dependencies"))
    rows = a.join(e, "network_id", "left")
    none = F.expr("cast(array() as array<struct<source:string,target:string>>)")
    stray = F.array(F.struct(F.lit("N01").alias("source"), F.lit("X").alias("target")))
    edges = F.coalesce("dependencies", none)
    rows = rows.withColumn("dependencies", F.when(k % 41 == 0, none).when(k % 37 == 0, F.concat(edges, stray)).otherwise(edges))
    return rows.withColumn("activities", F.when(k % 41 == 0, F.filter("activities", lambda x: F.lit(False))).otherwise(F.col("activities")))


BULK = """refused AS (SELECT network_id, CASE WHEN network_id % 41 = 0 THEN 'empty_graph' ELSE 'invalid_duration' END AS code FROM activities WHERE network_id % 41 = 0 OR duration > 49
  UNION SELECT DISTINCT network_id, 'missing_reference' FROM activities WHERE network_id % 37 = 0 AND network_id % 41 <> 0)"""


@query("gr02_bulk_networks", f"WITH {NETWORKS}, {BULK}, e AS (SELECT network_id, count(*) AS n FROM dependencies GROUP BY ALL) SELECT a.network_id, count(*) AS activities, coalesce(any_value(e.n), 0) AS dependencies FROM activities a LEFT JOIN e USING (network_id) WHERE a.network_id NOT IN (SELECT network_id FROM refused) GROUP BY a.network_id")
def bulk_networks(spark, d):
    activities, dependencies, _ = construct.activity_networks(nested(spark, d))
    a, e = (t.groupBy("network_id").agg(F.count("*").alias(n)) for t, n in ((activities, "activities"), (dependencies, "dependencies")))
    return a.join(e, "network_id", "left").select("network_id", "activities", F.coalesce("dependencies", F.lit(0)).alias("dependencies"))


@query("gr02_bulk_refusals", f"WITH {NETWORKS}, {BULK} SELECT network_id, code FROM refused")
def bulk_refusals(spark, d):
    return construct.activity_networks(nested(spark, d))[2].select("network_id", "code").distinct()


@query("gr02_bulk_event_networks", f"WITH {NETWORKS}, n AS (SELECT network_id, count(*) + 1 AS nodes, count(*) AS activities, sum(CASE WHEN seq > 0 THEN 1 ELSE 0 END) AS dependencies FROM activities GROUP BY ALL) SELECT network_id, nodes, activities, CAST(dependencies AS BIGINT) AS dependencies FROM n WHERE network_id % 43 <> 0")
def bulk_event_networks(spark, d):
    """Each network as a chain of events, its activities on the arrows; every 43rd names an event twice."""
    acts = derived.activities(spark, d)
    k = F.col("network_id")
    event = lambda i: F.concat(F.lit("E"), i.cast("string"))
    rows = acts.groupBy("network_id").agg(F.array_sort(F.collect_list(F.struct("seq", "activity_id", "duration"))).alias("a"))
    nodes = F.transform(F.concat(F.sequence(F.lit(0), F.size("a")), F.when(k % 43 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))), lambda i: F.struct(event(i).alias("node_id"), F.lit("").alias("label")))
    on_arrows = F.transform("a", lambda x: F.struct(x["activity_id"].alias("activity_id"), x["duration"].alias("duration"), event(x["seq"] - 1).alias("source_node"), event(x["seq"]).alias("target_node")))
    steps = F.transform("a", lambda x: F.struct(event(x["seq"] - 1).alias("source"), event(x["seq"]).alias("target")))
    built = construct.event_networks(rows.select("network_id", nodes.alias("nodes"), on_arrows.alias("activities"), steps.alias("dependencies")))
    n, a, e = (t.groupBy("network_id").agg(F.count("*").alias(name)) for t, name in zip(built, ("nodes", "activities", "dependencies")))  # noqa: B905
    return n.join(a, "network_id").join(e, "network_id")


@query("gr24_calculated", f"{CPM}, {BULK}, alone AS (SELECT network_id FROM activities GROUP BY network_id HAVING count(*) = 1) SELECT p.network_id, CASE WHEN p.network_id IN (SELECT network_id FROM refused) THEN 'REFUSED' WHEN p.network_id IN (SELECT network_id FROM alone) THEN 'INVALID' ELSE 'RUNNABLE' END AS gate, CASE WHEN p.network_id NOT IN (SELECT network_id FROM refused) AND p.network_id NOT IN (SELECT network_id FROM alone) THEN p.pd END AS project_duration FROM project p")
def calculated(spark, d):
    """From nested rows to a schedule: construction, checks, gate. A single activity is isolated and does not pass."""
    return construct.calculated(nested(spark, d))


# --- results table and settings -----------------------------------------------------------


@query("so05_sorted_results", f"WITH {ACTIVITIES}, r AS (SELECT network_id, activity_id, CASE WHEN seq % 4 = 0 THEN NULL ELSE duration END AS shown FROM activities) SELECT network_id, activity_id, row_number() OVER (PARTITION BY network_id ORDER BY coalesce(shown, 'infinity'::DOUBLE), activity_id) AS by_duration, row_number() OVER (PARTITION BY network_id ORDER BY coalesce(CAST(shown AS VARCHAR), ''), activity_id) AS by_text FROM r")
def sorted_results(spark, d):
    """Places of a results table's rows when it is sorted by a column as numbers and as text."""
    rows = derived.activities(spark, d).withColumn("shown", F.when(F.col("seq") % 4 != 0, F.col("duration")))
    place = lambda numeric: F.row_number().over(W.partitionBy("network_id").orderBy(*report.sort_keys("shown", numeric), "activity_id"))
    return rows.select("network_id", "activity_id", place(True).alias("by_duration"), place(False).alias("by_text"))


@query("va20_setting_issues", """WITH c AS (SELECT p_partkey AS config_id, p_size % 7 AS blur, (p_size * 40) % 2500 AS min_width, p_size - 5 AS low FROM part),
i AS (SELECT config_id, 'max_width' AS setting FROM c WHERE 2000 < min_width UNION ALL SELECT config_id, 'blur_kernel_size' FROM c WHERE blur < 1 UNION ALL SELECT config_id, 'blur_kernel_size' FROM c WHERE blur % 2 = 0
  UNION ALL SELECT config_id, 'canny_low_threshold' FROM c WHERE low < 0 UNION ALL SELECT config_id, 'canny_high_threshold' FROM c WHERE 150 < low * 4)
SELECT config_id, setting, count(*) AS n FROM i GROUP BY ALL""")
def setting_issues(spark, d):
    p = derived.read(spark, d, "part")
    low = F.col("p_size") - 5
    given = p.select(F.col("p_partkey").alias("config_id"), (F.col("p_size") % 7).alias("blur_kernel_size"), (F.col("p_size") * 40 % 2500).alias("min_width"), F.when(low < 0, low).otherwise(low * 4).alias("canny_low_threshold"))
    return settings.setting_issues(given, "preprocess").groupBy("config_id", "setting").agg(F.count("*").alias("n"))
