"""Ground-truth annotations as JSON files, version 1.0, and listings of diagram files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
SCHEMA = """schema_version string, image string, diagram_type string, annotation_status string,
activities array<struct<id:string,duration:double,position:array<double>,bbox:array<double>,bounding_box:array<double>,predecessors:array<string>,successors:array<string>,dummy:boolean>>,
events array<struct<id:string,position:array<double>,bbox:array<double>>>, dependencies array<string>,
expected_activities int, expected_events int, expected_dependencies int, uncertain struct<activities:array<string>,events:array<string>,dependencies:array<string>>, notes string"""
#: Files that hold diagrams.
IMAGES = "*.{png,jpg,jpeg,bmp,tif,tiff,webp}"


def parse(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows (image_key, json) -> image_key and the annotation's fields; entries of dependencies stay texts."""
    return rows.select("image_key", F.from_json(column, SCHEMA).alias("a")).select("image_key", "a.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Whole files; the key is a file's name without folder and ending."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return parse(spark.read.text(path, wholetext=True).select(stem.alias("image_key"), F.col("value").alias("json")))


def edges(annotations: DataFrame) -> DataFrame:
    """image_key, source, target: entries [s, t] or {source|source_id, target|target_id}, uncertain ones left out; first of equal ones."""
    e = annotations.select("image_key", F.posexplode("dependencies").alias("place", "e"), F.coalesce("uncertain.dependencies", F.array()).alias("unsure"))
    pair, item = F.from_json("e", "array<string>"), F.from_json("e", "source string, source_id string, target string, target_id string")
    listed = F.col("e").startswith("[")
    rows = e.select(
        "image_key", "place", "unsure",
        F.when(listed, F.get(pair, 0)).otherwise(F.coalesce(item["source"], item["source_id"])).alias("source"),
        F.when(listed, F.get(pair, 1)).otherwise(F.coalesce(item["target"], item["target_id"])).alias("target"),
    )
    sure = rows.filter(~F.array_contains("unsure", F.to_json(F.array("source", "target"))) & F.col("source").isNotNull() & F.col("target").isNotNull())
    return sure.groupBy("image_key", "source", "target").agg(F.min("place").alias("place"))


def activities(annotations: DataFrame) -> DataFrame:
    """image_key, id, duration, center, bbox of the certain activities; the centre is the position, else that of the box."""
    a = annotations.select("image_key", F.explode("activities").alias("a"), F.coalesce("uncertain.activities", F.array()).alias("unsure")).filter(~F.array_contains("unsure", F.col("a.id")))
    b = F.coalesce("a.bbox", "a.bounding_box")
    center = F.coalesce("a.position", F.when(F.size(b) >= 4, F.array(F.get(b, 0) + F.get(b, 2) / 2, F.get(b, 1) + F.get(b, 3) / 2)))
    return a.select("image_key", "a.id", "a.duration", center.alias("center"), b.alias("bbox"))


def discover(spark: SparkSession, path: str, pattern: str = IMAGES) -> DataFrame:
    """path, length and modificationTime of all files below a folder that match, sorted by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime").orderBy("path")


#: What an entry of a legacy list of activities may hold.
LEGACY_ENTRY = "id string, activity_id string, duration string, position array<double>, bounding_box array<double>, bbox array<double>"


def parse_legacy(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows (image_key, json text beside an image) of the older form, whose fields are all optional but dependencies.

    image_key, error, diagram_type (upper case), activities array<struct<id, duration, position, bbox>>, edges
    array<struct<source, target>>. Activities are a map by id or a list; durations, positions and bounding_boxes of the top level replace
    those of the entries where they are present. error names what cannot be read; such rows have null fields."""
    text = "map<string,string>"
    top = rows.select("image_key", F.from_json(column, text).alias("t"), F.trim(F.col(column)).startswith("{").alias("is_object"))
    get = lambda k: F.col("t")[k]
    info = lambda v: F.from_json(v, LEGACY_ENTRY)
    entry = lambda i, x: F.struct(i.alias("id"), x["duration"].try_cast("double").alias("duration"), x["position"].alias("position"), F.coalesce(x["bounding_box"], x["bbox"]).alias("bbox"))
    listed = F.transform(F.from_json(get("activities"), "array<string>"), lambda v: entry(F.coalesce(info(v)["id"], info(v)["activity_id"]), info(v)))
    mapped = F.transform(F.map_entries(F.from_json(get("activities"), text)), lambda e: entry(e["key"], info(e["value"])))
    acts = F.when(F.trim(get("activities")).startswith("["), listed).otherwise(mapped)
    pair, item = lambda v: F.from_json(v, "array<string>"), lambda v: F.from_json(v, "source string, source_id string, target string, target_id string")
    edge = lambda v: F.when(v.startswith("["), F.when(F.size(pair(v)) == 2, F.struct(pair(v)[0].alias("source"), pair(v)[1].alias("target")))).otherwise(F.struct(F.coalesce(item(v)["source"], item(v)["source_id"]).alias("source"), F.coalesce(item(v)["target"], item(v)["target_id"]).alias("target")))
    deps = F.transform(F.from_json(get("dependencies"), "array<string>"), edge)
    out = top.select("image_key", "t", "is_object", acts.alias("a"), deps.alias("edges"), *[F.from_json(get(k), f"map<string,{kind}>").alias(k) for k, kind in (("durations", "double"), ("positions", "array<double>"), ("bounding_boxes", "array<double>"))])
    error = (
        F.when(~F.coalesce("is_object", F.lit(False)) | F.col("t").isNull(), "not an object")
        .when(get("activities").isNotNull() & (F.col("a").isNull() | F.exists("a", lambda x: x["id"].isNull())), "activities")
        .when(F.col("edges").isNull() | F.exists("edges", lambda e: e.isNull() | e["source"].isNull() | e["target"].isNull()), "dependencies")
    )
    own = lambda top_level, x, field: F.when(F.col(top_level).isNotNull(), F.col(top_level)[x["id"]]).otherwise(x[field])
    merged = F.transform("a", lambda x: F.struct(x["id"].alias("id"), own("durations", x, "duration").alias("duration"), own("positions", x, "position").alias("position"), own("bounding_boxes", x, "bbox").alias("bbox")))
    out = out.withColumn("error", error)
    keep = lambda c: F.when(F.col("error").isNull(), c)
    return out.select("image_key", "error", keep(F.upper(get("diagram_type"))).alias("diagram_type"), keep(merged).alias("activities"), keep(F.col("edges")).alias("edges"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """parse_legacy() of whole files; the key is a file's name without folder and ending."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return parse_legacy(spark.read.text(path, wholetext=True).select(stem.alias("image_key"), F.col("value").alias("json")))
