"""CSV texts, projects, legacy annotations, settings, errors, bulk construction."""

import json

import pytest

from slackline import errors
from slackline.operators import construct
from slackline.plans.settings import DEFAULTS, Settings, setting_issues
from slackline.sources import annotations, csv_networks, json_networks


def test_csv_texts(spark, tmp_path):
    texts = {
        "plain": 'activity_id,name,duration,predecessors\nA,"first, ""one""",2.5,\nB,,3,"A"\r\n\nC,"two\nlines",4,"A, B"\n',
        "quoted lines": 'activity_id,Duration\n"A\nx",1\nB,2',
        "other order": "﻿ TIME , Activity_Id \n1e1,A\n,B\n",
        "bad rows": "activity_id,dur\nA,1\n,2\nC,x\nD,4",
        "no id": "id,duration\nA,1",
        "no duration": "activity_id,name\nA,a",
        "empty": "",
    }
    frame = spark.createDataFrame([(k, v) for k, v in [*texts.items(), ("null", None)]], "network_id string, csv string")
    activities, dependencies, found = csv_networks.parse_texts(frame)
    rows = {}
    for r in activities.collect():
        rows.setdefault(r.network_id, []).append((r.row_number, r.activity_id, r.name, r.duration))
    assert sorted(rows["plain"]) == [(2, "A", 'first, "one"', 2.5), (3, "B", "B", 3.0), (4, "C", "two\nlines", 4.0)]
    assert sorted(rows["quoted lines"]) == [(2, "A\nx", "A\nx", 1.0), (3, "B", "B", 2.0)]
    assert sorted(rows["other order"]) == [(2, "A", "A", 10.0), (3, "B", "B", None)]
    assert set(rows) <= {"plain", "quoted lines", "other order"}
    got = {(r.network_id, r.row_number, r.code, r.value) for r in found.collect()}
    assert {("bad rows", 3, "missing_activity_id", None), ("bad rows", 4, "invalid_duration", "x"), ("no id", None, "missing_column:activity_id", None), ("no duration", None, "missing_column:duration", None), ("empty", None, "empty", None), ("null", None, "empty", None)} <= got
    assert {("B", "A"), ("C", "A"), ("C", "B")} == {(r.target, r.source) for r in dependencies.filter("network_id = 'plain'").collect()}
    (tmp_path / "n.csv").write_text("activity_id,days,predecessors\nA,1,\nB,2,A\n")
    activities, dependencies, found = csv_networks.read_csv(spark, str(tmp_path), "Days")
    assert sorted((r.activity_id, r.duration) for r in activities.collect()) == [("A", 1.0), ("B", 2.0)] and found.count() == 0
    assert [(r.source, r.target) for r in dependencies.collect()] == [("A", "B")]


def test_projects(spark, tmp_path):
    acts = spark.createDataFrame([(1, "A", 1, 2.0), (1, "B", 2, 3.0)], "network_id long, activity_id string, seq int, duration double")
    deps = spark.createDataFrame([(1, "A", "B")], "network_id long, source string, target string")
    projects = spark.createDataFrame([(1, "p1", 'a "name"', None, {"k": "v"}), (2, "p2", None, "done", None)], "network_id long, project_id string, name string, status string, metadata map<string,string>")
    json_networks.write_projects(projects, acts, deps, f"{tmp_path}/p")
    back = json_networks.read_projects(spark, f"{tmp_path}/p")
    rows = {r.project_id: r for r in back.collect()}
    assert rows["p1"].name == 'a "name"' and rows["p1"].status == "draft" and rows["p1"].metadata == {"k": "v"} and rows["p2"].name == "Untitled Project" and rows["p2"].graph is None
    graphs = json_networks.project_graphs(back)
    assert [(r.activity_id, r.duration) for r in json_networks.activities(graphs).orderBy("seq").collect()] == [("A", 2.0), ("B", 3.0)]
    broken = json_networks.parse_projects(spark.createDataFrame([(1, "{}"), (2, "no json")], "network_id long, json string"))
    assert [r.error for r in broken.collect()] == ["project_info"] * 2


def test_legacy_annotations(spark, tmp_path):
    docs = {
        "map": {"diagram_type": "aoa", "activities": {"A": {"duration": 2, "position": [1, 2]}, "B": 5}, "dependencies": [["A", "B"]], "positions": {"B": [7, 8]}},
        "list": {"activities": [{"id": "A", "duration": "x", "bbox": [1, 2, 3, 4]}, {"activity_id": "B", "duration": 3}], "dependencies": [{"source_id": "A", "target": "B"}]},
        "none": {"dependencies": []}, "no_id": {"activities": [{"duration": 1}], "dependencies": []}, "short": {"dependencies": [["A"]]}, "missing": {"activities": {}}, "array": [1],
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    rows = {r.image_key: r for r in annotations.read_legacy(spark, str(tmp_path)).collect()}
    assert {k: r.error for k, r in rows.items()} == {"map": None, "list": None, "none": None, "no_id": "activities", "short": "dependencies", "missing": "dependencies", "array": "not an object"}
    assert rows["map"].diagram_type == "AOA" and {a.id: (a.duration, a.position) for a in rows["map"].activities} == {"A": (2.0, None), "B": (None, [7.0, 8.0])}
    assert [(a.id, a.duration, a.bbox) for a in rows["list"].activities] == [("A", None, [1.0, 2.0, 3.0, 4.0]), ("B", 3.0, None)]
    assert [(e.source, e.target) for e in rows["list"].edges] == [("A", "B")] and rows["none"].activities is None and rows["none"].edges == []


def test_settings(spark, tmp_path):
    s = Settings({"shape": {"min_circularity": 2}, "extra": 1})
    assert s.get("shape.min_circularity") == 2 and s.get("shape.min_rect_area") == DEFAULTS["shape"]["min_rect_area"] and s.get("shape.nothing.deeper", 5) == 5 and s.get("extra") == 1
    s.set("ocr.deep.value", 3)
    s.save(f"{tmp_path}/s.json")
    assert Settings.load(f"{tmp_path}/s.json").get("ocr.deep.value") == 3
    s.reset()
    assert s.get("extra") is None
    for section in DEFAULTS:
        assert setting_issues(spark.range(1).withColumnRenamed("id", "config_id"), section).count() == 0
    given = spark.createDataFrame([(1, 2.0, -1), (2, 0.5, 5)], "config_id int, min_circularity double, min_rect_area int")
    assert sorted((r.config_id, r.setting) for r in setting_issues(given, "shape").collect()) == [(1, "min_circularity"), (1, "min_rect_area")]


def test_errors(spark):
    issues = spark.createDataFrame([("n2", "cycle", ""), ("n1", "duplicate_activity", "A"), ("n1", "odd", None)], "network_id string, code string, element string")
    with pytest.raises(errors.KINDS["duplicate_activity"]) as e:
        errors.raise_first(issues)
    assert isinstance(e.value, errors.GraphError) and e.value.network_id == "n1" and "duplicate_activity" in str(e.value)
    with pytest.raises(errors.AnalysisError):
        errors.raise_first(issues.filter("network_id = 'n2'"))
    with pytest.raises(errors.NetworkError):
        errors.raise_first(issues.filter("code = 'odd'"))
    errors.raise_first(issues.filter("false"))


def test_bulk_construction(spark):
    act = "array<struct<activity_id:string,duration:double>>"
    edge = "array<struct<source:string,target:string>>"
    good = [("A", 2.0), ("B", 3.0)]
    rows = [("ok", good, [("A", "B")]), ("self", good, [("A", "A")]), ("twice", [*good, ("A", 1.0)], []), ("empty", [], []), ("null", None, None), ("alone", [("A", 1.0)], []), ("loop", good, [("A", "B"), ("B", "A")])]
    nets = spark.createDataFrame(rows, f"network_id string, activities {act}, dependencies {edge}")
    activities, dependencies, issues = construct.activity_networks(nets)
    assert {r.network_id for r in activities.collect()} == {"ok", "alone", "loop"} and dependencies.filter("network_id = 'ok'").count() == 1
    assert {(r.network_id, r.code) for r in issues.collect()} == {("self", "self_dependency"), ("twice", "duplicate_activity"), ("empty", "empty_graph"), ("null", "empty_graph")}
    got = {r.network_id: (r.gate, r.project_duration) for r in construct.calculated(nets).collect()}
    assert got == {"ok": ("RUNNABLE", 5.0), "self": ("REFUSED", None), "twice": ("REFUSED", None), "empty": ("REFUSED", None), "null": ("REFUSED", None), "alone": ("INVALID", None), "loop": ("INVALID", None)}
