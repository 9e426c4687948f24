"""Annotation files, listings and report sinks."""

import json

from slackline.operators import review
from slackline.sources import annotations, images, report_sinks


def test_annotations(spark, tmp_path):
    doc = {
        "schema_version": "1.0", "image": "a.png", "diagram_type": "AON", "annotation_status": "COMPLETE",
        "activities": [{"id": "A", "duration": 5, "position": [1, 2]}, {"id": "B", "bbox": [0, 0, 10, 20]}, {"id": "C", "bounding_box": [2, 2, 4, 4], "duration": None}],
        "dependencies": [["A", "B"], {"source": "B", "target": "C"}, {"source_id": "A", "target_id": "C"}, ["A", "B"], {"source": "C"}],
        "uncertain": {"activities": ["C"], "events": [], "dependencies": [["A", "C"]]},
    }
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "two.json").write_text(json.dumps({"image": "b.png"}))
    a = annotations.read_annotations(spark, str(tmp_path))
    assert {r.image_key: r.annotation_status for r in a.collect()} == {"one": "COMPLETE", "two": None}
    assert sorted((r.source, r.target) for r in annotations.edges(a).collect()) == [("A", "B"), ("B", "C")]
    rows = {r.id: r for r in annotations.activities(a).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].center == [1.0, 2.0] and rows["B"].center == [5.0, 10.0] and rows["B"].duration is None


def test_discovery(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.png", "deep/a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in annotations.discover(spark, str(tmp_path)).collect()] == ["b.png", "a.jpg"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1, None)], "name string, n int, note string")
    for kind in report_sinks.WRITERS:
        assert report_sinks.export(rows, f"{tmp_path}/{kind}", kind)["ok"]
        assert report_sinks.export(rows, f"{tmp_path}/{kind}", kind, append=True)["ok"]
    assert spark.read.json(f"{tmp_path}/json").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert {r.value for r in spark.read.text(f"{tmp_path}/markdown").collect()} == {r"| a\|b | 1 | - |"}
    assert report_sinks.header(["x", "y"]) == "| x | y |\n|-|-|"
    bad = report_sinks.export(rows, f"{tmp_path}/x", "pdf")
    assert not bad["ok"] and "pdf" in bad["error"]
    assert not report_sinks.export(rows.selectExpr("cast(name as int) / n as v"), f"{tmp_path}/y", "csv")["ok"]


def test_applied_reviews(spark):
    from pyspark.sql import functions as F

    acts = spark.createDataFrame([("n", a, k, 1.0) for k, a in enumerate("ABCD")], "network_id string, activity_id string, seq int, duration double")
    deps = spark.createDataFrame([("n", *e) for e in ("AB", "BC", "CD", "AD")], "network_id string, source string, target string")
    log = spark.createDataFrame([(1, "n:B", "CORRECT", "X"), (2, "n:D", "REJECT", None), (3, "n:D", "ACCEPT", None)], "seq long, item_id string, decision string, corrected_value string").withColumn("ts", F.timestamp_seconds("seq"))
    edge_log = spark.createDataFrame([(1, "n:B>C", "REVERSE", None), (2, "n:A>B", "ACCEPT", None)], "seq long, item_id string, decision string, new_end string").withColumn("ts", F.timestamp_seconds("seq"))
    a, d, issues = review.apply(acts, deps, log, edge_log)
    assert sorted(r.activity_id for r in a.collect()) == ["A", "C", "X"]
    assert sorted((r.source, r.target) for r in d.collect()) == [("A", "X"), ("C", "X")]
    assert issues.count() == 0
    twice = log.withColumn("corrected_value", F.when(F.col("item_id") == "n:B", "A"))
    assert [(r.code, r.element) for r in review.apply(acts, deps, twice, edge_log)[2].collect()] == [("duplicate_activity_id", "A")]


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc4\0\x02\xff\xc2\0\x11\x08" + (9).to_bytes(2, "big") + (700).to_bytes(2, "big")
    (tmp_path / "deep").mkdir()
    for name, data in {"a.png": png, "deep/b.JPG": jpeg, "c.gif": b"GIF89a\x01", "d.txt": png, "e.bmp": b"BM"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.width, r.height, r.problem) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 640, 480, None), "b.JPG": ("jpeg", 700, 9, "too small"), "c.gif": (None, None, None, "unreadable"), "e.bmp": (None, None, None, "unreadable")}
