"""Networks as JSON documents: project, activities, nodes, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
SCHEMA = """version string, project struct<diagram_type:string,confidence:double,metadata:map<string,string>>,
activities array<struct<activity_id:string,name:string,duration:double,is_dummy:boolean,source_node:string,target_node:string,optimistic_time:double,most_likely_time:double,pessimistic_time:double>>,
nodes array<struct<node_id:string,label:string,node_type:string>>,
dependencies array<struct<source:string,target:string,dependency_type:string,activity_id:string>>"""


def parse(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows (network_id, json text) -> network_id, g (the document), error (the first missing required key, or null)."""
    g = F.from_json(column, SCHEMA)
    parsed = rows.select("network_id", g.alias("g"))
    error = (
        F.when(F.col("g").isNull() | F.col("g.project").isNull(), "project")
        .when(F.exists(F.coalesce("g.activities", F.array()), lambda a: a["activity_id"].isNull()), "activity_id")
        .when(F.exists(F.coalesce("g.nodes", F.array()), lambda n: n["node_id"].isNull()), "node_id")
        .when(F.exists(F.coalesce("g.dependencies", F.array()), lambda d: d["source"].isNull() | d["target"].isNull()), "dependency")
    )
    return parsed.withColumn("error", error)


def activities(parsed: DataFrame) -> DataFrame:
    flat = parsed.filter("error is null").select("network_id", F.posexplode("g.activities").alias("seq", "a"))
    return flat.select("network_id", "seq", "a.*").withColumn("is_dummy", F.coalesce("is_dummy", F.lit(False)))


def dependencies(parsed: DataFrame) -> DataFrame:
    flat = parsed.filter("error is null").select("network_id", F.posexplode("g.dependencies").alias("seq", "d"))
    return flat.select("network_id", "seq", "d.*").withColumn("dependency_type", F.coalesce("dependency_type", F.lit("FINISH_TO_START")))


def to_json(activities: DataFrame, dependencies: DataFrame, diagram_type: str = "AON") -> DataFrame:
    """network_id and its JSON text; keys without value are left out."""
    keep = [c for c in ("activity_id", "name", "duration", "is_dummy", "optimistic_time", "most_likely_time", "pessimistic_time") if c in activities.columns]
    a = activities.groupBy("network_id").agg(F.expr(f"transform(array_sort(collect_list(struct(seq, struct({', '.join(keep)}) as a))), x -> x.a)").alias("activities"))
    d = dependencies.groupBy("network_id").agg(F.expr("array_sort(collect_list(struct(source, target)))").alias("dependencies"))
    doc = F.struct(F.lit(VERSION).alias("version"), F.struct(F.lit(diagram_type).alias("diagram_type"), F.lit(1.0).alias("confidence")).alias("project"), "activities", F.coalesce("dependencies", F.expr("cast(array() as array<struct<source:string,target:string>>)")).alias("dependencies"))
    return a.join(d, "network_id", "left").select("network_id", F.to_json(doc, {"ignoreNullFields": "true"}).alias("json"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a path, parsed; each file is a network named by its path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("network_id"), F.col("value").alias("json"))
    return parse(rows)


def write_json(activities: DataFrame, dependencies: DataFrame, path: str) -> None:
    to_json(activities, dependencies).select("json").write.mode("overwrite").text(path)


# --- projects: a network with what is known about it ----------------------------------------

INFO = "project_id string, name string, description string, created_at string, modified_at string, status string, metadata map<string,string>"
#: What a project has that its document leaves out.
DEFAULTS = {"project_id": "", "name": "Untitled Project", "description": "", "created_at": "", "modified_at": "", "status": "draft"}


def projects_to_json(projects: DataFrame, activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """projects (network_id and fields of INFO) -> network_id and the project's document; a project without activities has no graph."""
    known = [c.split(" ", 1)[0] for c in INFO.split(", ")]
    info = F.struct(*[c for c in known if c in projects.columns])
    graphs = to_json(activities, dependencies).withColumnRenamed("json", "graph")
    rows = projects.select("network_id", F.to_json(info, {"ignoreNullFields": "true"}).alias("info")).join(graphs, "network_id", "left")
    graph = F.coalesce(F.concat(F.lit(', "graph": '), "graph"), F.lit(""))
    return rows.select("network_id", F.concat(F.lit('{"version": "'), F.lit(VERSION), F.lit('", "project_info": '), "info", graph, F.lit("}")).alias("json"))


def parse_projects(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows (network_id, json) -> network_id, the project's fields with defaults, graph (JSON text or null) and error."""
    top = F.from_json(column, "map<string,string>")
    parsed = rows.select("network_id", top["project_info"].alias("p"), top["graph"].alias("graph")).withColumn("info", F.from_json("p", INFO))
    error = F.when(F.col("p").isNull() | F.col("info").isNull(), "project_info")
    fields = [F.coalesce(f"info.{c}", F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    return parsed.select("network_id", *fields, F.col("info.metadata").alias("metadata"), "graph", error.alias("error"))


def project_graphs(parsed: DataFrame) -> DataFrame:
    """parse() of the graphs of projects that have one."""
    return parse(parsed.filter("error is null and graph is not null").select("network_id", F.col("graph").alias("json")))


def write_projects(projects: DataFrame, activities: DataFrame, dependencies: DataFrame, path: str) -> None:
    projects_to_json(projects, activities, dependencies).select("json").write.mode("overwrite").text(path)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, as write_projects() leaves them; the key is the project's id."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("network_id"), F.col("value").alias("json"))
    return parse_projects(rows)
