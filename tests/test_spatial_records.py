"""Greedy choices against plain loops; sources, review log, stream and labels."""

import random

from pyspark.sql import functions as F

from slackline.functions import text
from slackline.operators import review, spatial
from slackline.sources import csv_networks, json_networks
from slackline.streaming import review as stream

BOX = "network_id int, node_id string, seq int, shape_type string, x double, y double, width double, height double, confidence double"


def boxes(seed=3, networks=6, size=18):
    rng = random.Random(seed)
    return [
        (n, f"B{k:02d}", k, rng.choice(["circle", "rectangle"]), rng.uniform(0, 300), rng.uniform(0, 200), rng.uniform(20, 90), rng.uniform(20, 70), rng.randrange(100) / 100)
        for n in range(networks) for k in range(size)
    ]


def depict_one(a, b):
    (ax, ay, aw, ah), (bx, by, bw, bh) = a[4:8], b[4:8]
    same = a[3] == b[3]
    both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
    if both / min(aw * ah, bw * bh) >= (0.5 if same else 0.6):
        return True
    inside = lambda p, q: p[4] >= q[4] - 5 and p[5] >= q[5] - 5 and p[4] + p[6] <= q[4] + q[6] + 5 and p[5] + p[7] <= q[5] + q[7] + 5
    ratio = min(min(aw, bw) / max(aw, bw), min(ah, bh) / max(ah, bh))
    if (inside(a, b) or inside(b, a)) and (same or ratio > 0.5):
        return True
    far = ((ax + aw / 2 - bx - bw / 2) ** 2 + (ay + ah / 2 - by - bh / 2) ** 2) ** 0.5
    return ratio > 0.6 and far / ((aw * ah + bw * bh) / 2) ** 0.5 < (0.15 if same else 0.08)


def test_suppression(spark):
    rows = boxes()
    got = {(r.network_id, r.node_id) for r in spatial.suppress_duplicates(spark.createDataFrame(rows, BOX)).collect()}
    want = set()
    for n in range(6):
        kept = []
        for b in sorted((r for r in rows if r[0] == n), key=lambda r: (-r[8], r[2])):
            if not any(depict_one(k, b) for k in kept):
                kept.append(b)
        want |= {(n, k[1]) for k in kept}
    assert got == want and len(want) < len(rows)


def test_matching_is_one_to_one_and_greedy(spark):
    rng = random.Random(5)
    pairs = [(n, f"g{a}", f"d{b}", round(rng.random(), 2), round(rng.random(), 1)) for n in range(5) for a in range(6) for b in range(6) if rng.random() < 0.5]
    got = {(r.network_id, r.gt_id, r.det_id) for r in spatial.greedy_matching(spark.createDataFrame(pairs, "network_id int, gt_id string, det_id string, score double, distance double")).collect()}
    want, used = set(), set()
    for n, a, b, _, _ in sorted(pairs, key=lambda p: (p[0], -p[3], p[4], p[1], p[2])):
        if (n, a) not in used and (n, b) not in used:
            used |= {(n, a), (n, b)}
            want.add((n, a, b))
    assert got == want


def test_text_groups(spark):
    rows = [(n, f"T{b[2]:02d}", b[2], f"t{b[2]}", *b[4:8], b[8]) for n, b in ((b[0], b) for b in boxes(9, 4, 14))]
    frame = spark.createDataFrame(rows, "network_id int, region_id string, seq int, text string, x double, y double, width double, height double, confidence double")
    got = {(r.network_id, r.seed, r.size) for r in spatial.text_groups(frame).collect()}
    want = set()

    def near(a, b):
        dx, dy = abs(a[4] + a[6] / 2 - b[4] - b[6] / 2), abs(a[5] + a[7] / 2 - b[5] - b[7] / 2)
        far = (dx * dx + dy * dy) ** 0.5
        return far <= 100 and ((dx < 50 and dy < 90) or (dy < 30 and dx < 50) or far < 50)

    for n in range(4):
        own, used = [r for r in rows if r[0] == n], set()
        for i, r in enumerate(own):
            if i in used:
                continue
            group = [i] + [j for j in range(len(own)) if j != i and j not in used and near(r, own[j])]
            used |= set(group)
            if len(group) >= 2:
                want.add((n, own[i][2], len(group)))
    assert got == want


def test_near_pairs_equals_all_pairs(spark):
    rows = boxes(11, 3, 20)
    frame = spark.createDataFrame(rows, BOX)
    points = frame.select("network_id", "node_id", (F.col("x") - 40).alias("px"), (F.col("y") + 35).alias("py"))
    got = {(r.network_id, r.node_id, r.b_node_id) for r in spatial.near_pairs(points, frame, "px", "py", 60.0, ["node_id"]).collect()}
    want = set()
    for a in rows:
        px, py = a[4] - 40, a[5] + 35
        for b in rows:
            dx, dy = px - max(b[4], min(px, b[4] + b[6])), py - max(b[5], min(py, b[5] + b[7]))
            if a[0] == b[0] and (dx * dx + dy * dy) ** 0.5 <= 60:
                want.add((a[0], a[1], b[1]))
    assert got == want


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "\ufeffActivity_ID, Name ,Dur,Predecessors,optimistic_time\n"
    (tmp_path / "in" / "a.csv").write_text(head + "A,Start,5,,1\nB,,3.5,\"A, A\",x\nC,End,,A B,0\nD,Odd,2,C,\n", encoding="utf-8")
    (tmp_path / "in" / "bad.csv").write_text(head + "A,Start,5,,1\n,bad,1,,\nD,Odd,two,A,\n", encoding="utf-8")
    acts, deps, errors = csv_networks.read_csv(spark, f"{tmp_path}/in")
    rows = {r.activity_id: r for r in acts.collect()}
    assert [(rows[k].name, rows[k].duration, rows[k].optimistic_time) for k in "ABCD"] == [("Start", 5.0, 1.0), ("B", 3.5, None), ("End", None, 0.0), ("Odd", 2.0, None)]
    assert sorted({(r.source, r.target) for r in deps.collect()}) == [("A", "B"), ("A", "C"), ("B", "C"), ("C", "D")]
    assert sorted((r.row_number, r.code) for r in errors.collect()) == [(3, "missing_activity_id"), (4, "invalid_duration")]
    split_acts, _, split_errors = csv_networks.read_split_csv(spark, f"{tmp_path}/in")
    assert split_acts.count() == 6 and sorted(r.code for r in split_errors.collect()) == ["invalid_duration", "missing_activity_id"]
    named = acts.withColumn("network_id", F.lit("n1")), deps.withColumn("network_id", F.lit("n1"))
    csv_networks.write_csv(*named, f"{tmp_path}/out")
    again, again_deps, _ = csv_networks.read_csv(spark, f"{tmp_path}/out/*")
    pick = lambda t: sorted((r.activity_id, r.duration, r.optimistic_time) for r in t.collect() if r.duration is not None)
    assert pick(again) == pick(acts)
    assert {(r.source, r.target) for r in again_deps.collect()} == {(r.source, r.target) for r in deps.collect()}


def test_json_round_trip_and_errors(spark, tmp_path):
    acts = spark.createDataFrame([("n", "A", 0, 5.0, None), ("n", "B", 1, 0.0, 1.5)], "network_id string, activity_id string, seq int, duration double, optimistic_time double")
    deps = spark.createDataFrame([("n", "A", "B")], "network_id string, source string, target string")
    json_networks.write_json(acts, deps, f"{tmp_path}/j")
    parsed = json_networks.read_json(spark, f"{tmp_path}/j/*.txt").filter("g is not null")
    back = json_networks.activities(parsed).orderBy("seq").collect()
    assert [(r.activity_id, r.duration, r.optimistic_time, r.is_dummy) for r in back] == [("A", 5.0, None, False), ("B", 0.0, 1.5, False)]
    assert [(r.source, r.target, r.dependency_type) for r in json_networks.dependencies(parsed).collect()] == [("A", "B", "FINISH_TO_START")]
    bad = [("1", "{}"), ("2", "no json"), ("3", '{"project":{},"activities":[{"name":"x"}]}'), ("4", '{"project":{},"nodes":[{}]}'), ("5", '{"project":{},"dependencies":[{"source":"A"}]}'), ("6", '{"project":{}}')]
    errors = {r.network_id: r.error for r in json_networks.parse(spark.createDataFrame(bad, "network_id string, json string")).collect()}
    assert errors == {"1": "project", "2": "project", "3": "activity_id", "4": "node_id", "5": "dependency", "6": None}


LOG = "seq long, item_id string, decision string, ts timestamp, corrected_value double"


def test_review_log(spark):
    rows = [(1, "a", "LEAVE_UNRESOLVED", 1, None), (2, "a", "CORRECT", 2, None), (3, "a", "CORRECT", 3, 7.0), (4, "a", "REJECT", 4, None), (5, "b", "REJECT", 1, None), (6, "c", "ACCEPT", 1, None), (7, "d", "NOISE", 1, None)]
    log = spark.createDataFrame([(s, i, d, t, v) for s, i, d, t, v in rows], "seq long, item_id string, decision string, ts long, corrected_value double").withColumn("ts", F.timestamp_seconds("ts"))
    items = spark.createDataFrame([(x, 1.0) for x in "abcde"], "item_id string, value double")
    got = {r.item_id: r.status for r in review.statuses(items, log).collect()}
    assert got == {"a": "CORRECTED", "b": "REJECTED", "c": "ACCEPTED", "d": "PENDING", "e": "PENDING"}
    assert {r.item_id: r.value for r in review.overlay(items, log).collect()} == {"a": 7.0, "c": 1.0, "d": 1.0, "e": 1.0}


def test_review_stream(spark, tmp_path):
    rows = [(k, f"i{k % 5}", ["LEAVE_UNRESOLVED", "ACCEPT", "REJECT"][k % 3], 1000 + k) for k in range(60)]
    log = spark.createDataFrame(rows, "seq long, item_id string, decision string, t long").select("seq", "item_id", "decision", F.timestamp_seconds("t").alias("ts"), F.lit(None).cast("double").alias("corrected_value"))
    log.write.parquet(f"{tmp_path}/log")
    source = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    q = stream.first_decisions(source).writeStream.format("memory").queryName("decided").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r.item_id for r in spark.table("decided").collect()]
    assert sorted(got) == [f"i{k}" for k in range(5)]


def test_label_texts(spark):
    rows = ["A12", "  x-3.5 ", "1,234.50", "3/6 or 4 - 8", "٣٤", "", None, "é label", "-7", "a​  b", "ﬁne"]
    frame = spark.createDataFrame([(r,) for r in rows], "t string")
    c = F.col("t")
    got = frame.select(text.text_type(c), text.numbers_in(c), text.extracted_id(c), text.is_plausible_id(c), text.normalised(text.nfkc(c))).collect()
    assert [r[0] for r in got] == ["activity_id", "text_label", "numeric", "text_label", "unknown", "unknown", "unknown", "text_label", "numeric", "text_label", "text_label"]
    assert [r[1] for r in got][:4] == [[12.0], [-3.5], [1234.5], [3.0, 6.0, 4.0, 8.0]]
    assert got[0][2:4] == ("A12", True) and got[6][3] is False
    assert [r[4] for r in got][-2:] == ["a b", "fine"] and got[4][4] == "34"
