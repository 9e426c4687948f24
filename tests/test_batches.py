"""Kernels over batches of networks against the rounds of joins and against whole sets of paths."""

import random

import pytest

from slackline.operators import schedule

ACTS = "network_id int, activity_id string, seq int, duration double, variance double"
DEPS = "network_id int, source string, target string"


def random_networks(spark, count, seed=5):
    rng = random.Random(seed)
    acts, deps = [], []
    for n in range(count):
        size = rng.randrange(1, 12)
        order = rng.sample(range(size), size)
        acts += [(n, f"v{order[k]}", k, rng.choice([1.0, 1.0, 2.0, 0.1, 0.2]), rng.choice([0.0, 0.3, 0.7])) for k in range(size)]
        deps += [(n, f"v{a}", f"v{b}") for a in range(size) for b in range(a + 1, size) if rng.random() < 0.3]
        if n % 10 == 7 and size > 1:  # a cycle, an unknown end, a repeated edge
            deps += [(n, "v0", "v1"), (n, "v1", "v0"), (n, "v0", "zz")] if n % 20 == 7 else deps[-1:]
    return spark.createDataFrame(acts, ACTS), spark.createDataFrame(deps, DEPS)


def test_first_walk_agrees_with_all_walks(spark):
    acts, deps = random_networks(spark, 60)
    paths = schedule.path_variance(schedule.critical_paths(acts, deps, full_length=False), acts)
    want = paths.join(schedule.summary(schedule.schedule(acts, deps)), "network_id")
    got = schedule.first_walk_totals(acts, deps).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_walk_by_rounds(spark):
    acts, deps = (t.filter("network_id < 8") for t in random_networks(spark, 8))
    want, got = (schedule.first_walk_totals(acts, deps, fold_limit=k) for k in (256, 0))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_first_walk_builds_no_other(spark):
    """2 ** 60 critical walks; the first takes a through every rung."""
    n = 60
    acts = [(1, f"m{k:02}", 3 * k, 1.0, 1.0) for k in range(n + 1)] + [(1, f"{s}{k:02}", 3 * k + 1 + (s == "b"), 2.0, 2.0 if s == "a" else 5.0) for k in range(n) for s in "ab"]
    deps = [(1, *e) for k in range(n) for s in "ab" for e in ((f"m{k:02}", f"{s}{k:02}"), (f"{s}{k:02}", f"m{k + 1:02}"))]
    row = schedule.first_walk_totals(spark.createDataFrame(acts, ACTS), spark.createDataFrame(deps, DEPS)).first()
    assert (row.project_variance, row.project_duration, row.critical_count, row.non_critical_count) == (61 + 120, 61 + 120, 181, 0)
    assert row.project_deviation == pytest.approx(181**0.5)


def test_missing_durations_offer_nothing(spark):
    acts = spark.createDataFrame([(1, "A", 1, 3.0), (1, "B", 2, None), (1, "C", 3, 2.0), (2, "A", 1, None)], "network_id int, activity_id string, seq int, duration double")
    deps = spark.createDataFrame([(1, "A", "B"), (1, "B", "C"), (1, "A", "C"), (1, None, "C"), (3, "A", "B")], DEPS)
    rows = {(r.network_id, r.activity_id): r for r in schedule.fold_schedule(acts, deps).collect()}
    assert len(rows) == 4
    assert [(rows[1, v].early_start, rows[1, v].early_finish, rows[1, v].late_start, rows[1, v].is_critical) for v in "ABC"] == [(0, 3, 0, True), (3, None, None, None), (3, 5, 3, True)]
    assert rows[2, "A"].early_finish is None and rows[2, "A"].project_duration == 0


def test_reviewed_schedules_agree_with_joins(spark):
    """Random decisions of all kinds, several an item, some of them unusable; at least a fifth of the networks stays sound."""
    from slackline.operators import review

    rng = random.Random(11)
    acts, deps, ids, ends = [], [], [], []
    for n in range(400):
        size = rng.randrange(1, 6)
        acts += [(n, f"v{k}" if rng.random() < 0.99 else rng.choice(["", None, "v0"]), k, rng.choice([1.0, 2.0, 3.5] * 9 + [0.0, None])) for k in range(size)]
        edges = [(f"v{a}", f"v{b}") for a in range(size) for b in range(a + 1, size) if b == a + 1 or rng.random() < 0.3]
        deps += [(n, *e) for e in edges] + [(n, "v0", "zz")] * (n % 9 == 0) + [(n, *e) for e in edges[: n % 13 == 0]]
        for k in range(size):
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                ids.append((n, rng.randrange(3), f"{n}:v{k}", rng.choice(["ACCEPT", "REJECT", "CORRECT", "CORRECT", "COMMENT"]), rng.choice([None, "v0", f"w{k}", f"w{k}"])))
        for s, t in edges:
            for _ in range(rng.choice([0, 0, 1, 2])):
                ends.append((n, rng.randrange(3), f"{n}:{s}>{t}", rng.choice(["ACCEPT", "REJECT", "REVERSE", "CHANGE_SOURCE", "CHANGE_TARGET", "?"]), rng.choice([None, "v0", "v1", "v3"])))
    acts = spark.createDataFrame(acts, "network_id int, activity_id string, seq int, duration double")
    deps = spark.createDataFrame(deps, "network_id int, source string, target string")
    logs = [spark.createDataFrame(log, f"network_id int, seq long, item_id string, decision string, {value} string").selectExpr("*", "timestamp'2024-01-01' as ts") for log, value in ((ids, "corrected_value"), (ends, "new_end"))]
    want, got = (sorted(map(tuple, review.scheduled(acts, deps, *logs, fold_limit=k).collect())) for k in (0, 256))
    assert got == want and 80 < len(got) < 400


def test_loop_by_slices(spark, monkeypatch):
    """Networks dealt to slices come out as by the fold, cycles and unknown ends among them, and tables between rounds are gone after each slice."""
    from slackline.plans.iterate import Store

    dropped = []
    monkeypatch.setattr(Store, "drop", lambda self, names, f=Store.drop: (dropped.append(len(names)), f(self, names)))
    acts, deps = (t.filter("network_id < 18") for t in random_networks(spark, 18))
    want = schedule.fold_schedule(acts, deps)
    rows = acts.count()
    got = schedule.loop_schedule(acts, deps, slice_rows=-(-rows // 2))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(dropped) == 2 and min(dropped) >= 4
