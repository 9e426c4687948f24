"""Pair scores and suppression against plain Python."""

import math
import random

import pytest

from slackline.operators import pairing

BOX = "network_id int, node_id string, seq int, x double, y double, width double, height double"
SEG = "network_id int, segment_id string, seq int, x1 double, y1 double, x2 double, y2 double, head_conf double, confidence double"


def scene(seed, n=4):
    rng = random.Random(seed)
    boxes = [(k, f"B{i}", i, rng.uniform(0, 500), rng.uniform(0, 300), rng.uniform(30, 90), rng.uniform(20, 60)) for k in range(n) for i in range(9)]
    segments = []
    for k in range(n):
        own = [b for b in boxes if b[0] == k]
        for i in range(10):
            a, b = rng.sample(own, 2)
            if i % 5 == 4:  # a stub inside one box
                p, q = (a[3] + 5, a[4] + 5), (a[3] + a[5] - 6, a[4] + a[6] - 4)
            else:
                p, q = (a[3] + a[5] + rng.uniform(-3, 12), a[4] + a[6] / 2), (b[3] + rng.uniform(-12, 3), b[4] + b[6] / 2)
            segments.append((k, f"S{i}", i, *p, *q, rng.choice([0.0, 0.2, 0.9]), rng.random()))
    return boxes, segments


def distance(p, b):
    dx, dy = p[0] - max(b[3], min(p[0], b[3] + b[5])), p[1] - max(b[4], min(p[1], b[4] + b[6]))
    return math.sqrt(dx * dx + dy * dy)


def inside(p, b):
    return b[3] <= p[0] <= b[3] + b[5] and b[4] <= p[1] <= b[4] + b[6]


def center(b):
    return b[3] + b[5] / 2, b[4] + b[6] / 2


def hits(p, d, b):
    out = []
    for axis, low, size in ((0, b[3], b[5]), (1, b[4], b[6])):
        other_low, other_size = (b[4], b[6]) if axis == 0 else (b[3], b[5])
        for edge in (low, low + size):
            if abs(d[axis]) > 1e-9:
                t = (edge - p[axis]) / d[axis]
                across = p[1 - axis] + t * d[1 - axis]
                if t >= 0 and other_low - 1 <= across <= other_low + other_size + 1:
                    out.append(t)
    return out


def enters(p, d, b, pad):
    near, far = 0.0, math.inf
    for axis, low, size in ((0, b[3], b[5]), (1, b[4], b[6])):
        low, high = low - pad, low + size + pad
        if abs(d[axis]) < 1e-9:
            if not low <= p[axis] <= high:
                return None
        else:
            t = sorted(((low - p[axis]) / d[axis], (high - p[axis]) / d[axis]))
            near, far = max(near, t[0]), min(far, t[1])
    return near if near <= far else None


def ladder(v, limits, beyond):
    return next((value for limit, value in limits if v < limit), beyond)


def score(s, a, b, boxes):
    p, q = s[3:5], s[5:7]
    length = math.dist(p, q)
    d = ((q[0] - p[0]) / length, (q[1] - p[1]) / length)
    contact = lambda x, box: ladder(distance(x, box), ((2, 1.0), (15, 0.9), (30, 0.7), (50, 0.5), (80, 0.3)), 0.0)
    close = lambda x, box: ladder(distance(x, box), ((5, 1.0), (20, 0.8), (50, 0.5), (100, 0.3)), 0.1)

    def ray(x, way, box):
        t = hits(x, way, box)
        return ladder(min(t), ((5, 1.0), (30, 0.8), (80, 0.5)), 0.3) if t else 0.0

    ca, cb = center(a), center(b)
    path = math.dist(ca, cb)
    dot = (d[0] * (cb[0] - ca[0]) + d[1] * (cb[1] - ca[1])) / path
    near = max(0.0, min(1.0, 1 - (distance(p, a) + distance(q, b)) / 200))
    to_a, to_b = math.dist(p, ca), math.dist(q, cb)
    angle_a = max(0.0, -(d[0] * (ca[0] - p[0]) + d[1] * (ca[1] - p[1])) / to_a) if to_a >= 1e-6 else 0.5
    angle_b = max(0.0, (d[0] * (cb[0] - q[0]) + d[1] * (cb[1] - q[1])) / to_b) if to_b >= 1e-6 else 0.5
    crossing = min(1.0, 0.3 * sum(any(0 < t < length for t in hits(p, d, c)) for c in boxes if c[1] not in (a[1], b[1])))
    floating = float(s[7] <= 0 and min(distance(p, c) for c in boxes) > 12 and min(distance(q, c) for c in boxes) > 12)
    total = (
        0.22 * (contact(p, a) + contact(q, b)) + 0.12 * (close(p, a) + close(q, b)) + 0.08 * (ray(p, d, a) + ray(q, (-d[0], -d[1]), b)) + 0.1 * (max(0.0, dot) * 0.6 + near * 0.4)
        + 0.06 * (angle_a + angle_b) / 2 - 0.15 * crossing + 0.03 * ladder(path, ((100, 0.8), (300, 0.6), (600, 0.4)), 0.2) - 0.25 * floating
    )
    return max(0.0, min(1.0, total * (0.3 if length < 10 else 0.6 if length < 20 else 1))), floating


def resolve(s, boxes):
    p, q = s[3:5], s[5:7]
    near = []
    for x in (p, q):
        ranked = sorted((b for b in boxes if distance(x, b) <= 120), key=lambda b: (-round(max(0.0, 1 - distance(x, b) / 120) + 0.4 * inside(x, b), 9), b[2]))
        near.append(ranked[:4])
    pairs, seen = [], set()
    for a in near[0]:
        for b in near[1]:
            if a is not b and frozenset((a[1], b[1])) not in seen:
                seen.add(frozenset((a[1], b[1])))
                value, floating = score(s, a, b, boxes)
                pairs.append((round(value, 9), a, b, floating))
    if not pairs:
        return None
    pairs.sort(key=lambda x: -x[0])
    value, a, b, floating = pairs[0]
    margin = round(value - pairs[1][0], 9) if len(pairs) > 1 else None
    status = "REJECTED" if value < 0.1 else "REVIEW_REQUIRED" if margin is not None and margin < 0.15 else "CONFIRMED" if value >= 0.5 else "CONTEXTUALLY_RESOLVED"
    stub = False
    holder = next((c for c in boxes if inside(q, c)), None)
    if s[7] > 0 and holder is not None and inside(p, holder):
        length = math.dist(p, q)
        d = ((q[0] - p[0]) / length, (q[1] - p[1]) / length)
        ahead = [(t, c[2], c[1]) for c in boxes if c is not holder and (t := enters(q, d, c, 4.0)) is not None]
        stub = not ahead or min(ahead)[2] not in (a[1], b[1])
    doubtful = 0 < s[7] < 0.3 and math.dist(p, q) >= 100 and value < 0.8 and margin is not None and margin < 0.25
    if status != "REJECTED" and (floating or stub or doubtful):
        status = "REVIEW_REQUIRED"
    return a[1], b[1], value, margin, status


def test_resolved_pairs(spark):
    boxes, segments = scene(8)
    got = {(r.network_id, r.segment_id): r for r in pairing.resolved_pairs(spark.createDataFrame(segments, SEG), spark.createDataFrame(boxes, BOX)).collect()}
    statuses = set()
    for s in segments:
        want = resolve(s, [b for b in boxes if b[0] == s[0]])
        r = got.get((s[0], s[1]))
        assert (want is None) == (r is None)
        if want:
            statuses.add(want[4])
            assert (r.score, r.margin) == (pytest.approx(want[2], abs=1e-8), want[3] if want[3] is None else pytest.approx(want[3], abs=1e-8))
            assert {r.node_a, r.node_b} == {want[0], want[1]} and r.status == want[4]
    assert len(statuses) >= 2


def test_swapping_ends_keeps_confirmed_pairs(spark):
    boxes, segments = scene(21)
    turned = [(k, i, s, x2, y2, x1, y1, 0.0, c) for k, i, s, x1, y1, x2, y2, _, c in segments]
    plain = [(*s[:7], 0.0, s[8]) for s in segments]
    frame = spark.createDataFrame(boxes, BOX)
    one, two = ({(r.network_id, r.segment_id): frozenset((r.node_a, r.node_b)) for r in pairing.resolved_pairs(spark.createDataFrame(x, SEG), frame).filter("status = 'CONFIRMED'").collect()} for x in (plain, turned))
    shared = one.keys() & two.keys()
    assert shared and all(one[k] == two[k] for k in shared)


def test_segment_suppression(spark):
    rng = random.Random(2)
    rows = []
    for k in range(4):
        for i in range(8):
            x, y, a, n = rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, math.pi), rng.uniform(20, 120)
            rows.append((k, f"S{i}", 3 * i, x, y, x + n * math.cos(a), y + n * math.sin(a), 0.0, round(rng.random(), 3)))
            for j in (1, 2):
                dx, dy = rng.uniform(-5, 5), rng.uniform(-5, 5)
                rows.append((k, f"R{i}{j}", 3 * i + j, x + dx, y + dy, x + dx + n * math.cos(a), y + dy + n * math.sin(a), 0.0, round(rng.random(), 3)))
    got = {(r.network_id, r.segment_id) for r in pairing.suppress_segments(spark.createDataFrame(rows, SEG)).collect()}

    def same(a, b):
        turn = lambda s: math.degrees(math.atan2(s[6] - s[4], s[5] - s[3])) % 180
        n = math.dist(a[3:5], a[5:7])
        u = ((a[5] - a[3]) / n, (a[6] - a[4]) / n)
        side = max(abs((p[0] - a[3]) * u[1] - (p[1] - a[4]) * u[0]) for p in (b[3:5], b[5:7]))
        low, high = sorted((p[0] - a[3]) * u[0] + (p[1] - a[4]) * u[1] for p in (b[3:5], b[5:7]))
        overlap = min(n, high) - max(0, low)
        return abs(turn(a) - turn(b)) <= 8 and side <= 6 and overlap >= 0 and min(n, high - low) > 1e-6 and overlap / min(n, high - low) >= 0.5

    want = set()
    for k in range(4):
        kept = []
        for s in (r for r in rows if r[0] == k):
            parent = next((p for p in kept if same(p, s)), None)
            if parent is None:
                kept.append(s)
            elif s[8] > parent[8]:
                kept.remove(parent)
                kept.append(s)
        want |= {(k, s[1]) for s in kept}
    assert got == want and len(want) < len(rows)


def test_text_suppression(spark):
    rows = [(1, "a", 0, "X", 0.0, 0.0, 10.0, 10.0, 0.5), (1, "b", 1, "X", 90.0, 0.0, 10.0, 10.0, 0.9), (1, "c", 2, "x", 91.0, 0.0, 10.0, 10.0, 0.4), (1, "d", 3, "x", 300.0, 0.0, 10.0, 10.0, 0.3), (2, "a", 0, "X", 0.0, 0.0, 1.0, 1.0, 0.1)]
    frame = spark.createDataFrame(rows, "network_id int, region_id string, seq int, text string, x double, y double, width double, height double, confidence double")
    assert sorted((r.network_id, r.region_id) for r in pairing.suppress_texts(frame).collect()) == [(1, "b"), (1, "d"), (2, "a")]
