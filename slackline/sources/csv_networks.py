"""Networks as CSV: activity_id, name, duration, predecessors and three optional estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Headers that may hold the duration, in order of preference.
DURATIONS = ("duration", "dur", "time")
ESTIMATES = ("optimistic_time", "most_likely_time", "pessimistic_time")
COLUMNS = ("activity_id", "name", "duration", "predecessors", *ESTIMATES)


#: A record up to its end of line, quoted cells with their line ends; a cell after its comma.
RECORD = r'((?:"(?:[^"]++|"")*+"|[^"\r\n]++)*+)(?:\r?\n|$)'
CELL = r',((?:"(?:[^"]++|"")*+"|[^",]++)*+)'


def cells(record: Column) -> Column:
    """array<string>: the cells of a CSV record, trimmed, without their quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CELL), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')).otherwise(c)
    return F.transform(raw, lambda c: F.trim(plain(F.trim(c))))


def parse_texts(texts: DataFrame, duration_column: str = "duration") -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (network_id, csv), a whole CSV each -> activities, dependencies and errors (network_id, row_number, code, value).

    Headers match without regard to case, outer blanks and a byte order mark, in any order and differently in each text.
    Row numbers count from 2, the header being row 1; empty lines do not count. A text without rows, or without the
    column activity_id or any for durations, has an error without a row number. A network with errors has no activities."""
    body = F.regexp_replace(F.coalesce("csv", F.lit("")), "^\ufeff", "")
    records = F.filter(F.regexp_extract_all(body, F.lit(RECORD), F.lit(1)), lambda r: r != "")
    rows = texts.select("network_id", records.alias("r")).withColumn("header", F.transform(cells(F.coalesce(F.get("r", 0), F.lit(""))), F.lower))
    wanted = dict.fromkeys((*DURATIONS, duration_column.lower()))
    has = lambda c: F.array_contains("header", c)
    duration = F.coalesce(*[F.when(has(c), F.lit(c)) for c in wanted])
    rows = rows.withColumn("duration_column", duration)
    problem = F.when(F.size("r") == 0, "empty").when(~has("activity_id"), "missing_column:activity_id").when(F.col("duration_column").isNull(), "missing_column:duration")
    rows = rows.withColumn("problem", problem)
    whole = rows.filter("problem is not null").select("network_id", F.lit(None).cast("int").alias("row_number"), F.col("problem").alias("code"), F.lit(None).cast("string").alias("value"))
    flat = rows.filter("problem is null").select("network_id", "header", "duration_column", F.posexplode(F.expr("slice(r, 2, size(r))")).alias("place", "record"))
    flat = flat.withColumn("row_number", (F.col("place") + 2).cast("int")).withColumn("c", cells(F.col("record")))
    at = lambda name: F.nullif(F.get("c", F.array_position("header", name).cast("int") - 1), F.lit(""))
    value = {c: F.when(has(c), at(c)) for c in ("activity_id", "name", "predecessors", *ESTIMATES)}
    value["duration"] = at(F.col("duration_column"))
    flat = flat.select("network_id", "row_number", *[v.alias(c) for c, v in value.items()])
    number = F.col("duration").try_cast("double")
    code = F.when(F.col("activity_id").isNull(), "missing_activity_id").when(F.col("duration").isNotNull() & number.isNull(), "invalid_duration")
    marked = flat.withColumn("code", code)
    errors = marked.filter("code is not null").select("network_id", "row_number", "code", F.when(F.col("code") == "invalid_duration", F.col("duration")).alias("value")).unionByName(whole)
    bad = F.max(F.col("code").isNotNull()).over(W.partitionBy("network_id"))
    good = marked.withColumn("bad", bad).filter("not bad")
    activities = good.select("network_id", "activity_id", (F.col("row_number") - 1).alias("seq"), "row_number", F.coalesce("name", "activity_id").alias("name"), number.alias("duration"), *[F.col(c).try_cast("double").alias(c) for c in ESTIMATES])
    sources = F.filter(F.split(F.coalesce("predecessors", F.lit("")), r"[,\s]+"), lambda p: p != "")
    return activities, good.select("network_id", F.explode(sources).alias("source"), F.col("activity_id").alias("target")), errors


def read_csv(spark: SparkSession, path: str, duration_column: str = "duration") -> tuple[DataFrame, DataFrame, DataFrame]:
    """parse_texts() of the files of a path, each read whole; each file is a network named by its path."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("network_id"), F.col("value").alias("csv"))
    return parse_texts(texts, duration_column)


def read_split_csv(spark: SparkSession, path: str, duration_column: str = "duration") -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_csv() for networks whose files are too large for one row: files are split, so errors have no row numbers.

    Headers match without regard to case, outer blanks and a byte order mark; the columns may
    differ between files only in order when they are read together. A blank duration stays null, estimates that are no numbers
    become null. Rows without activity_id are errors."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c: c.lstrip("﻿").strip().lower() for c in raw.columns}
    rows = raw.withColumn("network_id", F.col("_metadata.file_path")).withColumnsRenamed(names)
    known = set(rows.columns)
    if "activity_id" not in known:
        raise ValueError("no activity_id column")
    duration = next((c for c in (*DURATIONS, duration_column) if c in known), None)
    text = lambda c: F.trim(F.col(c)) if c in known else F.lit(None).cast("string")
    number = lambda c: F.nullif(text(c), F.lit("")).try_cast("double")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    good = rows.filter(F.coalesce(text("activity_id"), F.lit("")) != "")
    activities = good.select(
        "network_id", text("activity_id").alias("activity_id"), "seq", F.coalesce(text("name"), text("activity_id")).alias("name"),
        (number(duration) if duration else F.lit(None).cast("double")).alias("duration"), *[number(c).alias(c) for c in ESTIMATES],
    )
    sources = F.filter(F.split(F.coalesce(text("predecessors"), F.lit("")), r"[,\s]+"), lambda p: p != "")
    dependencies = good.select("network_id", F.explode(sources).alias("source"), text("activity_id").alias("target"))
    bad_number = F.lit(False) if not duration else (F.coalesce(text(duration), F.lit("")) != "") & number(duration).isNull()
    errors = rows.filter(F.coalesce(text("activity_id"), F.lit("")) == "").select("network_id", F.lit("missing_activity_id").alias("code")).unionByName(rows.filter(bad_number).select("network_id", F.lit("invalid_duration").alias("code")))
    return activities, dependencies, errors


def export_rows(activities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The CSV's columns, all text, predecessors sorted and joined by blanks; a zero estimate is written, only null is blank."""
    before = dependencies.groupBy("network_id", F.col("target").alias("activity_id")).agg(F.array_join(F.array_sort(F.collect_set("source")), " ").alias("predecessors"))
    rows = activities.join(before, ["network_id", "activity_id"], "left")
    have = set(activities.columns)
    cell = lambda c: F.col(c).cast("string") if c in have or c == "predecessors" else (F.col("activity_id") if c == "name" else F.lit(None).cast("string"))
    return rows.select("network_id", *[cell(c).alias(c) for c in COLUMNS])


def write_csv(activities: DataFrame, dependencies: DataFrame, path: str) -> None:
    """A folder for each network (network_id=...), one header a file."""
    export_rows(activities, dependencies).write.partitionBy("network_id").option("header", True).mode("overwrite").csv(path)
