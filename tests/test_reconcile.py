"""Reconciliation, unique ids, cycles, event networks and networks too large for one row, against plain Python."""

import itertools
import random

from slackline.operators import evidence, event_accuracy, graph, reconstruct, schedule, validate


def test_unique_ids(spark):
    rng = random.Random(3)
    rows = []
    for net in range(6):
        for seq in range(14):
            ids = rng.choice("ABCD")
            alternatives = [(rng.choice([*"ABCDEF", "12", "b"]), rng.randrange(5) / 10) for _ in range(rng.randrange(4))]
            rows.append((net, seq, seq, ids, rng.choice([ids, ids, None]), "CONFIRMED", rng.randrange(4) / 4, alternatives))
        rows.append((net, 99, 99, None, None, "REVIEW_REQUIRED", 0.5, None))
    frame = spark.createDataFrame(rows, "network_id int, node_id int, seq int, raw string, resolved_id string, status string, confidence double, alternatives array<struct<id:string,confidence:double>>")
    got = {(r.network_id, r.node_id): (r.resolved_id, r.status) for r in evidence.unique_ids(frame).collect()}
    want = {}
    for net in range(6):
        groups = {}
        for r in rows:
            if r[0] == net:
                groups.setdefault(r[4] or r[3], []).append(r)
        for claim, members in groups.items():
            members.sort(key=lambda r: (-r[6], r[2]))
            used = {members[0][4]}
            for k, r in enumerate(members):
                pick, status = (r[4], r[5]) if not k or claim is None else (None, "REVIEW_REQUIRED")
                if k and claim is not None:
                    for a, _ in sorted(r[7], key=lambda x: -x[1]):
                        if len(a) == 1 and "A" <= a <= "Z" and a not in used:
                            pick, status = a, "CONTEXTUALLY_RESOLVED"
                            used.add(a)
                            break
                want[net, r[1]] = (pick, status)
    assert got == want


def networks(spark, edges, n):
    acts = spark.createDataFrame([(k, f"v{v:03d}", v, 1.0 + v % 5) for k in edges for v in range(n)], "network_id int, activity_id string, seq int, duration double")
    deps = spark.createDataFrame([(k, f"v{a:03d}", f"v{b:03d}") for k, pairs in edges.items() for a, b in pairs], "network_id int, source string, target string")
    return acts, deps


def test_example_cycles(spark):
    rng = random.Random(1)
    edges = {k: {(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 9))} for k in range(25)}
    acts, deps = networks(spark, edges, 6)
    got = {r.network_id: tuple(int(c[1:]) for c in r.cycle) for r in graph.example_cycles(acts, deps).collect()}
    for k, pairs in edges.items():
        every = [p for size in range(1, 7) for p in itertools.permutations(range(6), size) if all((a, b) in pairs for a, b in zip(p, (*p[1:], p[0]), strict=True))]
        best = min(every, key=lambda p: (p[0], len(p), p), default=None)
        assert got.get(k) == best


def test_large_networks_take_the_loop(spark):
    """The same results by folds and by rounds of joins, for a network above the limit beside small ones."""
    rng = random.Random(2)
    edges = {0: {(a, rng.randrange(a + 1, 300)) for a in range(299) for _ in range(2)}, 1: {(0, 1), (1, 2)}, 2: {(0, 1), (1, 0)}}
    acts, deps = networks(spark, {0: edges[0]}, 300)
    small_a, small_d = networks(spark, {k: edges[k] for k in (1, 2)}, 3)
    acts, deps = acts.union(small_a), deps.union(small_d)
    for f in (graph.levels, graph.acyclic, validate.component_counts):
        switched, folded = (sorted(map(tuple, f(acts, deps, limit).collect())) for limit in (100, 10_000))
        assert switched == folded and len(switched) >= 2
    a, b = (sorted((r.activity_id, r.early_start, r.late_finish, r.is_critical) for r in schedule.schedule(acts, deps, fold_limit=limit).collect()) for limit in (100, 10_000))
    assert a == b and len(a) == 303


def test_event_networks(spark):
    box = "network_id int, node_id string, seq int, x double, y double, width double, height double"
    truth = spark.createDataFrame([(1, f"g{k}", k, 200.0 * k, 100.0, 40.0, 40.0) for k in range(4)], box)
    found = spark.createDataFrame([(1, f"d{k}", k, 200.0 * k + 5, 103.0, 40.0, 40.0) for k in (2, 1, 0)] + [(1, "far", 9, 5000.0, 0.0, 40.0, 40.0)], box)
    edges = spark.createDataFrame([(1, "g0", "g1"), (1, "g1", "g2"), (1, "g2", "g3")], "network_id int, source string, target string")
    arrows = spark.createDataFrame([(1, "a", 45.0, 120.0, 205.0, 120.0, 1.0), (1, "b", 405.0, 120.0, 245.0, 120.0, -1.0), (1, "c", 300.0, 300.0, 410.0, 120.0, None)], "network_id int, arrow_id string, x1 double, y1 double, x2 double, y2 double, dx double")
    events = found.selectExpr("network_id", "node_id as event_id", "seq", "x + 20 as cx", "y + 20 as cy", "20.0D as radius")
    assert sorted((r.arrow_id, r.source, r.target) for r in event_accuracy.arrow_pairs(arrows, events).collect()) == [("a", "d0", "d1"), ("b", "d1", "d2"), ("c", None, "d2")]
    r = event_accuracy.compare(truth, edges, found, arrows).first()
    assert (r.expected_events, r.detected_events, r.matched_events, r.mapped_arrows, r.unresolved_arrows) == (4, 4, 3, 2, 1)
    assert (r.arrow_precision, r.arrow_recall, r.direction_accuracy) == (1.0, 0.6667, 1.0)


def test_reconstructed_dependencies(spark):
    found = spark.createDataFrame([(1, "n1", "n2", "HIGH", False), (1, "n2", "n1", "LOW", False), (1, "n1", "n2", "HIGH", True), (1, "n2", "n9", "HIGH", False), (1, "n3", "n3", "HIGH", False), (2, "n1", "n2", "HIGH", False)], "network_id int, source string, target string, level string, is_duplicate boolean")
    acts = spark.createDataFrame([(1, f"n{k}", f"A{k}") for k in (1, 2, 3)], "network_id int, node_id string, activity_id string")
    assert [tuple(r) for r in reconstruct.dependencies(found, acts).collect()] == [(1, "A1", "A2")]
