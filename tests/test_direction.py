"""Orientation scores against plain Python."""

import math

import pytest

from slackline.operators import direction, pairing
from tests.test_pairing import BOX, SEG, center, distance, hits, inside, scene

NORMALS = {"left": (-1, 0), "right": (1, 0), "top": (0, -1), "bottom": (0, 1)}


def contact(p, b):
    far, (cx, cy) = distance(p, b), center(b)
    if far > 80:
        return "far", far, (0, 0), 0.0
    if 0.05 <= (p[0] - b[3]) / b[5] <= 0.95 and 0.05 <= (p[1] - b[4]) / b[6] <= 0.95:
        return "inside", far, (0, 0), 0.3
    left, right, top, bottom = abs(p[0] - b[3]), abs(p[0] - b[3] - b[5]), abs(p[1] - b[4]), abs(p[1] - b[4] - b[6])
    if max(min(left, right), min(top, bottom)) < 0.2 * min(b[5], b[6]):
        return "corner", far, (-0.707 if p[0] < cx else 0.707, -0.707 if p[1] < cy else 0.707), max(0.0, 1 - far / 30)
    side = ("left" if left < right else "right") if min(left, right) < min(top, bottom) else ("top" if top < bottom else "bottom")
    return side, far, NORMALS[side], max(0.0, 1 - far / 80)


def project(p, d, b):
    found = []
    for k, (side, edge) in enumerate((("left", b[3]), ("right", b[3] + b[5]), ("top", b[4]), ("bottom", b[4] + b[6]))):
        axis = k // 2
        if abs(d[axis]) > 1e-9 and (t := (edge - p[axis]) / d[axis]) >= 0:
            across, low, size = p[1 - axis] + t * d[1 - axis], b[4 - axis], b[6 - axis]
            if low - 1 <= across <= low + size + 1:
                found.append((t, k, side))
    return (min(found)[2], 0.0, NORMALS[min(found)[2]], 0.7) if found else None


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1]


def lean(v):
    return min(1.0, 1.5 * v) if v > 0 else 0.0


def turn(a, b):
    d = abs(a - b) % (2 * math.pi)
    d = 2 * math.pi - d if d > math.pi else d
    return 0.0 if d > math.radians(40) else 1 - d / math.radians(40) * 0.5


def unit(a, b):
    n = math.dist(a, b)
    return n, ((b[0] - a[0]) / n, (b[1] - a[1]) / n) if n > 1e-6 else (0.0, 0.0)


def met(p, d, target, boxes):
    return min(1.0, 0.3 * sum(any(t > 0 for t in hits(p, d, b)) for b in boxes if b is not target))


def tip_score(tip, conf, b):
    if tip is None:
        return 0.0
    far = distance(tip, b)
    return (1.0 if far < 10 else 0.7 if far < 30 else 0.4 if far < 60 else 0.1) * conf


def independent(p1, p2, axis, tip, conf, s, t, boxes):
    sc, tc, a1, a2 = contact(p1, s), contact(p2, t), contact(p1, t), contact(p2, s)
    if a1[1] + a2[1] < sc[1] + tc[1]:
        sc, tc = a2, a1
    back = (-axis[0], -axis[1])
    if sc[0] == "inside":
        sc = project(p1, axis, s) or sc
    if tc[0] == "inside":
        tc = project(p2, back, t) or tc
    if tc[0] == "far" or tc[1] > 40:
        tc = project(p2, axis, t) or tc
    if sc[0] == "far" or sc[1] > 40:
        sc = project(p1, back, s) or sc
    far = "far" in (sc[0], tc[0])
    normals = 0.0 if far else (max(0.0, dot(sc[2], axis)) * sc[3] + max(0.0, -dot(tc[2], axis)) * tc[3]) / 2
    exits = 0.0 if sc[0] in ("far", "inside") else lean(dot(sc[2], axis)) * sc[3]
    enters = 0.0 if tc[0] in ("far", "inside") else lean(-dot(tc[2], axis)) * tc[3]
    near = lambda b: max(0.0, 1 - min(distance(p1, b), distance(p2, b)) / 80)
    joined = 0.0 if far else (near(s) * sc[3] + near(t) * tc[3]) / 2
    sides = (sc[0], tc[0])
    bonus = 0.3 * (sides == ("right", "left") and axis[0] < 0 or sides == ("left", "right") and axis[0] > 0 or sides == ("bottom", "top") and axis[1] < 0 or sides == ("top", "bottom") and axis[1] > 0)
    path = 0.0 if far else min(1.0, (exits + enters) / 2 + bonus)
    cs, ct = center(s), center(t)
    angle = turn(math.atan2(ct[1] - cs[1], ct[0] - cs[0]), math.atan2(axis[1], axis[0]))
    crossing = met(p1, axis, t, boxes)
    if conf > 0.3:
        total = 0.3 * tip_score(tip, conf, t) + 0.15 * (exits + enters) + 0.15 * normals + 0.1 * path + 0.1 * joined + 0.05 * angle - 0.1 * crossing
    else:
        total = 0.25 * (exits + enters) + 0.2 * normals + 0.15 * path + 0.1 * joined + 0.05 * angle - 0.1 * crossing
    return max(0.0, min(1.0, total))


def orientation(p1, p2, tip, conf, s, t, forward, boxes):
    length, axis = unit(p1, p2)
    way = axis if forward else (-axis[0], -axis[1])
    sp, tp = (p1, p2) if forward else (p2, p1)
    os, ot = contact(sp, s), contact(tp, t)
    if os[0] == "inside":
        os = project(sp, way, s) or os
    if ot[0] == "inside":
        ot = project(tp, (-way[0], -way[1]), t) or ot

    def boundary(p, b, c):
        far = distance(p, b)
        own = (0.8 if inside(p, b) else 0.95) if far < 2 else 0.7 if far < 24 else 0.4 if far < 48 else 0.2 if far < 80 else 0.0
        return max(own, c[3] * 0.8) if c[3] > 0.5 and c[0] not in ("far", "inside") else own

    def normal(p, b, c, sign):
        n, u = unit(center(b), p)
        own = 0.0 if n < 1e-6 else lean(sign * dot(u, way))
        value = sign * dot(c[2], way)
        return max(own, lean(value) * c[3]) if c[3] > 0.5 and c[2] != (0, 0) and value > 0 else own

    cs, ct = center(s), center(t)
    apart, c = unit(cs, ct)
    along = dot(c, way)
    flow = 0.6 + 0.4 * along if along > 0.5 else 0.3 * along if along > 0 else 0.0
    ratio = length / apart
    fits = 0.8 if 0.5 < ratio < 2 else 0.5 if 0.3 < ratio < 3 else 0.2
    has = tip is not None
    alone = independent(p1, p2, axis, tip, conf, s, t, boxes)
    own = (
        0.18 * (tip_score(tip, conf, t) if has else 0.3) + 0.15 * boundary(sp, s, os) + 0.15 * boundary(tp, t, ot) + 0.12 * normal(sp, s, os, 1) + 0.12 * normal(tp, t, ot, -1)
        + (0.1 if has else 0.02) * max(0.0, along) + 0.07 * turn(math.atan2(ct[1] - sp[1], ct[0] - sp[0]), math.atan2(way[1], way[0])) + 0.1 * flow
        + (0.05 if has else 0.01) * max(0.0, dot(axis, c)) + 0.03 * fits - 0.13 * met(sp, way, t, boxes)
    )
    w = 0.15 if has else 0.35
    return max(0.0, min(1.0, w * alone + (1 - w) * own)), alone


def test_directions(spark):
    boxes, segments = scene(14, 3)
    segment_frame, box_frame = spark.createDataFrame(segments, SEG), spark.createDataFrame(boxes, BOX)
    ordered = direction.in_geometric_order(segment_frame)
    pairs = pairing.resolved_pairs(ordered, box_frame)
    got = {(r.network_id, r.segment_id, r.forward): r for r in direction.orientations(pairs, ordered, box_frame).collect()}
    chosen = {(r.network_id, r.segment_id): r for r in direction.resolved_directions(pairs, ordered, box_frame).collect()}
    assert len(got) == 2 * len(chosen) > 20
    by_id = {(b[0], b[1]): b for b in boxes}
    seen = set()
    for s in segments:
        if (s[0], s[1]) not in chosen:
            continue
        own = [b for b in boxes if b[0] == s[0]]
        p1, p2 = sorted((s[3:5], s[5:7]))
        tip = s[5:7] if s[7] > 0 else None
        want = {}
        for forward in (True, False):
            r = got[s[0], s[1], forward]
            want[forward], alone = orientation(p1, p2, tip, s[7], by_id[s[0], r.source], by_id[s[0], r.target], forward, own)
            assert r.score == pytest.approx(want[forward], abs=1e-8) and r.independent == pytest.approx(alone, abs=1e-8)
        best = max(want.values())
        margin = abs(want[True] - want[False])
        lost = tip is None and math.dist(p1, p2) >= 150 and margin < 0.2
        status = "REVIEW_REQUIRED" if lost else "CONFIRMED" if margin >= 0.2 and best >= 0.5 else "CONTEXTUALLY_RESOLVED" if best >= 0.3 else "REVIEW_REQUIRED" if best >= 0.1 else "REJECTED"
        r = chosen[s[0], s[1]]
        assert r.status == status and r.score == pytest.approx(best, abs=1e-8)
        seen.add(status)
    assert len(seen) >= 2


def test_validated_dependencies(spark):
    boxes, segments = scene(14, 3)
    segment_frame, box_frame = spark.createDataFrame(segments, SEG), spark.createDataFrame(boxes, BOX)
    rows = direction.validated_dependencies(segment_frame, box_frame).collect()
    assert {r.level for r in rows} <= {"HIGH", "MEDIUM", "LOW", "REJECTED"} and any(r.level == "HIGH" for r in rows)
    accepted = [(r.network_id, r.source, r.target) for r in rows if r.level == "HIGH" and not r.is_duplicate]
    assert len(accepted) == len(set(accepted))
    turned = spark.createDataFrame([(k, i, s, x2, y2, x1, y1, 0.0, c) for k, i, s, x1, y1, x2, y2, _, c in segments], SEG)
    plain = spark.createDataFrame([(*s[:7], 0.0, s[8]) for s in segments], SEG)
    one, two = (sorted((r.network_id, r.segment_id, r.source, r.target, r.level) for r in direction.validated_dependencies(x, box_frame).collect()) for x in (plain, turned))
    assert one == two
