"""Arrow groups against a plain loop."""

import math
import random

from slackline.operators import association

SEG = "network_id int, segment_id string, seq int, x1 double, y1 double, x2 double, y2 double, head_conf double, confidence double"


def alike(a, b):
    (p, q), (r, s) = (a[3:5], a[5:7]), (b[3:5], b[5:7])
    n, m = math.dist(p, q), math.dist(r, s)
    cosine = ((q[0] - p[0]) * (s[0] - r[0]) + (q[1] - p[1]) * (s[1] - r[1])) / (n * m)
    near = min(math.dist(u, v) for u in (p, q) for v in (r, s))
    middle = math.dist([(u + v) / 2 for u, v in zip(p, q, strict=True)], [(u + v) / 2 for u, v in zip(r, s, strict=True)])
    return abs(cosine) >= 0.7 and near <= 40 and middle <= 50 and min(n, m) / max(n, m) >= 0.3


def test_arrow_groups(spark):
    rng = random.Random(6)
    rows = []
    for k in range(5):
        for i in range(25):
            x, y = rng.uniform(0, 250), rng.uniform(0, 250)
            rows.append((k, f"S{i:02d}", i, x, y, x + rng.uniform(-90, 90), y + rng.uniform(-90, 90), 0.0, round(rng.random(), 4)))
    got = {(r.network_id, r.segment_id, r.pieces) for r in association.deduplicate_arrows(spark.createDataFrame(rows, SEG)).collect()}
    want = set()
    for k in range(5):
        own, used = [r for r in rows if r[0] == k], set()
        for i, a in enumerate(own):
            if i in used:
                continue
            group = [i] + [j for j in range(i + 1, len(own)) if j not in used and alike(a, own[j])]
            used |= set(group)
            want.add((k, own[max(group, key=lambda j: own[j][8])][1], len(group)))
    assert got == want and any(n > 1 for _, _, n in want)


def test_far_nodes_give_no_end(spark):
    arrows = spark.createDataFrame([(1, "S", 0, 0.0, 0.0, 100.0, 0.0, 0.9, 0.5), (1, "Z", 1, 5.0, 5.0, 5.0, 5.0, 0.0, 0.5)], SEG)
    nodes = spark.createDataFrame([(1, "A", 0, -40.0, -10.0, 35.0, 20.0, 0.9), (1, "B", 1, 105.0, -10.0, 35.0, 20.0, 0.9)], "network_id int, node_id string, seq int, x double, y double, width double, height double, confidence double")
    rows = {r.segment_id: r for r in association.associated(arrows, nodes).collect()}
    assert (rows["S"].source, rows["S"].target, rows["S"].reason) == ("A", "B", None)
    assert rows["Z"].reason == "no_valid_source"
