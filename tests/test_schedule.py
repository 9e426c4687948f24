"""Hand-computed networks, and the agreement of the two strategies."""

import random

import pytest

from slackline.operators import graph, schedule, validate


def network(spark, text, edges, key="n"):
    """'A5 B3' and 'A>B' as tables."""
    acts = [(key, a[0] if not a[1:2].isalpha() else a[:2], k, float(a.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") or 0)) for k, a in enumerate(text.split())]
    deps = [(key, *e.split(">")) for e in edges.split()]
    return spark.createDataFrame(acts, "network_id string, activity_id string, seq int, duration double"), spark.createDataFrame(deps, "network_id string, source string, target string")


CASES = {
    "single": ("A5", "", 5, {"A": 0}, ["A"]),
    "branch": ("A2 B4 C1 D3", "A>B A>C B>D C>D", 9, {"C": 3}, ["A>B>D"]),
    "noncritical": ("A5 B3 C1 D2", "A>B A>C B>D C>D", 10, {"C": 2}, ["A>B>D"]),
    "two": ("A3 B4 C4 D2", "A>B A>C B>D C>D", 9, {"A": 0, "B": 0, "C": 0, "D": 0}, ["A>B>D", "A>C>D"]),
    "predecessors": ("A3 B5 C2", "A>C B>C", 7, {"A": 2}, ["B>C"]),
    "floating": ("A2.5 B1.75 C3.25", "A>B B>C", 7.5, {"A": 0}, ["A>B>C"]),
    "terminals": ("A5 B3 C4", "A>B A>C", 9, {"B": 1}, ["A>C"]),
    "complex": ("A.001 B5 C4 D3 E6 F2", "A>B A>C B>D C>E D>E D>F E>F", 16.001, {"C": 4}, ["A>B>D>E>F"]),
    "diamond": ("A2 B4 C3 D5 E2", "A>B A>D B>C C>E D>E", 11, {"D": 2}, ["A>B>C>E"]),
    "parallel": ("A3 B4 C5 D2", "A>B C>D", 7, {"A": 0, "C": 0}, ["A>B", "C>D"]),
    "backward": ("A4 B3 C5 D2", "A>B A>C B>D C>D", 11, {"B": 2}, ["A>C>D"]),
    "unsorted": ("D2 C5 B3 A4", "A>B A>C B>D C>D A>B", 11, {"B": 2}, ["A>C>D"]),
    "short chain apart": ("A9 B1", "", 9, {"B": 8}, ["A"]),
}


@pytest.mark.parametrize("name", CASES)
def test_networks(spark, name):
    text, edges, duration, floats, paths = CASES[name]
    acts, deps = network(spark, text, edges)
    for rows in (schedule.fold_schedule(acts, deps).collect(), schedule.schedule(acts, deps, fold_limit=1).collect()):
        by_id = {r.activity_id: r for r in rows}
        assert len(rows) == len(text.split()) and rows[0].project_duration == pytest.approx(duration, abs=1e-12)
        assert {a: by_id[a].total_float for a in floats} == pytest.approx(floats, abs=1e-9)
        targets = {e.split(">")[0] for e in edges.split()}
        assert all(r.free_float == 0 for r in rows if r.activity_id not in targets)
    assert [">".join(r.path) for r in schedule.critical_paths(acts, deps).orderBy("path_rank").collect()] == paths


GOLD = "A1 B2 C2 D3 E4 F4 G4 H4 I5 J5 K3 L6 M6 N8 O3 P4 Q3 R2 S1 T2 U1 V1"
GOLD_EDGES = "A>B A>C B>D C>D D>E D>F D>G D>H E>I F>I G>I H>I I>J J>K K>L K>M L>N M>N N>O N>P O>P P>Q Q>R R>S R>T S>T T>U U>V"


def test_critical_paths_have_no_cap(spark):
    n = 14
    acts = [("n", f"m{k:02}", 3 * k, 1.0) for k in range(n + 1)] + [("n", f"{s}{k:02}", 3 * k + 1 + (s == "b"), 2.0) for k in range(n) for s in "ab"]
    deps = [("n", *e) for k in range(n) for s in "ab" for e in ((f"m{k:02}", f"{s}{k:02}"), (f"{s}{k:02}", f"m{k + 1:02}"))]
    acts, deps = spark.createDataFrame(acts, "network_id string, activity_id string, seq int, duration double"), spark.createDataFrame(deps, "network_id string, source string, target string")
    paths = schedule.critical_paths(acts, deps)
    row = paths.agg({"path": "count", "path_rank": "max", "walks": "min"}).first()
    assert sorted(row) == [2**n, 2**n, 2.0**n]
    assert {tuple(r) for r in schedule.critical_edges(acts, deps).collect()} == {tuple(r) for r in deps.collect()}


@pytest.mark.parametrize("limits", [{"fold_limit": 1}, {"fold_walks": 5}])
def test_critical_paths_by_rounds(spark, limits):
    acts, deps = network(spark, GOLD, GOLD_EDGES)
    for full in (True, False):
        want = sorted(map(tuple, schedule.critical_paths(acts, deps, full).collect()))
        assert want == sorted(map(tuple, schedule.critical_paths(acts, deps, full, **limits).collect()))
    pairs = graph.consecutive_pairs(schedule.critical_paths(acts, deps))
    assert set(map(tuple, pairs.collect())) == set(map(tuple, schedule.critical_edges(acts, deps).collect()))


def test_gold_network(spark):
    acts, deps = network(spark, GOLD, GOLD_EDGES)
    rows = {r.activity_id: r for r in schedule.schedule(acts, deps).collect()}
    assert len(rows) == 22 and all(r.is_critical for r in rows.values())
    assert rows["A"].project_duration == 54
    assert [(rows[a].early_start, rows[a].early_finish) for a in "OPT"] == [(37, 40), (40, 44), (50, 52)]
    assert schedule.critical_paths(acts, deps).count() == 16
    assert schedule.critical_paths(acts, deps, full_length=False).count() == 64
    many = schedule.critical_paths(acts, deps, full_length=False, max_paths=10).collect()
    assert len(many) == 1 and many[0].path is None and many[0].walks == 64


def test_fold_and_loop_agree_on_random_networks(spark):
    rng = random.Random(1)
    acts, deps = [], []
    for n in range(25):
        size = rng.randrange(1, 14)
        order = list(range(size))
        rng.shuffle(order)
        acts += [(n, f"v{order[k]}", k, rng.choice([0.1, 0.2, 1.5, 3.0, 7.25])) for k in range(size)]
        for a in range(size):
            for b in range(a + 1, size):
                if rng.random() < 0.25:
                    deps.append((n, f"v{a}", f"v{b}"))
    acts = spark.createDataFrame(acts, "network_id int, activity_id string, seq int, duration double")
    deps = spark.createDataFrame(deps, "network_id int, source string, target string")
    one = sorted(map(tuple, schedule.fold_schedule(acts, deps).collect()))
    two = sorted(map(tuple, schedule.loop_schedule(acts, deps).select(*schedule.SCHEDULE).collect()))
    assert one == two and len(one) == acts.count()


def test_cycles_get_no_schedule(spark):
    acts, deps = network(spark, "A1 B2 C3", "A>B B>C C>A")
    assert schedule.schedule(acts, deps).count() == 0 and schedule.schedule(acts, deps, fold_limit=1).count() == 0
    assert [r.is_dag for r in graph.acyclic(acts, deps).collect()] == [False]
    assert {r.code for r in validate.graph_issues(acts, deps).collect()} == {"cycle"}
    assert validate.first_error(acts, deps).first().code == "cycle"


def test_validation_codes(spark):
    acts, deps = network(spark, "A1 B0 C3 D2", "A>B A>B B>B X>A C>Y")
    found = sorted((r.code, r.element) for r in validate.graph_issues(acts, deps).collect())
    assert found == [
        ("cycle", ""), ("disconnected_components", "3"), ("duplicate_edge", "A->B"), ("isolated_activity", "C"), ("isolated_activity", "D"),
        ("missing_duration", "B"), ("self_loop", "B"), ("unknown_dependency_source", "X"), ("unknown_dependency_target", "Y"),
    ]
    assert validate.first_error(acts, deps).first().code == "missing_duration"


def test_estimates(spark):
    rows = [("n", "A", "1", "2", "3"), ("n", "B", "x", "2", "1"), ("n", "C", None, "4", "5"), ("n", "D", "-1", "inf", "9"), ("n", "E", "5", "2", "3")]
    acts = spark.createDataFrame(rows, "network_id string, activity_id string, optimistic_time string, most_likely_time string, pessimistic_time string")
    found = sorted((r.activity_id, r.code) for r in validate.pert_issues(acts).collect())
    assert found == [("B", "pert_estimate_not_numeric"), ("B", "pert_ordering"), ("C", "missing_pert_estimate"), ("D", "pert_estimate_invalid"), ("D", "pert_estimate_invalid"), ("E", "pert_ordering"), ("E", "pert_ordering")]
    assert validate.pert_status(acts).first().status == "PERT_INVALID"
    assert validate.pert_status(acts.filter("activity_id in ('A', 'C')")).first().status == "PERT_REVIEW_REQUIRED"


def test_probability(spark):
    from pyspark.sql import functions as F

    from slackline.functions.numbers import completion_probability

    rows = spark.createDataFrame([(10.0, 10.0, 2.0), (10000.0, 10.0, 2.0), (-100.0, 10.0, 2.0), (9.0, 10.0, 0.0), (10.0, 10.0, 0.0), (12.0, 10.0, 2.0), (1.0, 1.0, -1.0)], "t double, m double, s double")
    got = [r[0] for r in rows.select(completion_probability(F.col("t"), F.col("m"), F.col("s"))).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] > 0.999 and got[2] < 0.001 and got[3:5] == [0.0, 1.0]
    assert got[5] == pytest.approx(0.8413447460685429, abs=1e-12) and got[6] is None
