"""Queries over label texts, evidence, metrics and review decisions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slackline.functions import numbers, text
from slackline.operators import evidence, metrics, report, review, schedule
from slackline.plans import derived
from slackline.plans.derived_sql import BOXES, DECISIONS, NETWORKS
from slackline.queries_networks import CPM, nets
from slackline.queries_spatial import shape_counts, size_stats

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- label texts --------------------------------------------------------------------------

LABELS = """labels_in AS (SELECT p_partkey AS region, CASE p_partkey % 12 WHEN 0 THEN 'A' || CAST(p_partkey % 100 AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '3/' || CAST(p_size AS VARCHAR)
  WHEN 3 THEN '  x-' || CAST(p_size AS VARCHAR) || '.5 ' WHEN 4 THEN '1,234.50' WHEN 5 THEN p_name WHEN 6 THEN 'é  label ' || CAST(p_partkey % 9 AS VARCHAR) WHEN 7 THEN '' WHEN 8 THEN NULL
  WHEN 9 THEN '٣٤' WHEN 10 THEN 'INFERRED_' || CAST(p_partkey % 1000 AS VARCHAR) ELSE CAST(p_partkey % 50 AS VARCHAR) || 'B' END AS text, (p_partkey % 100) / 100.0::DOUBLE AS confidence FROM part)"""


def labels_in(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    s = lambda c: c.cast("string")
    kind = (k % 12).cast("int")
    t = F.when(kind == 0, F.concat(F.lit("A"), s(k % 100))).when(kind == 1, size).when(kind == 2, F.concat(F.lit("3/"), size)).when(kind == 3, F.concat(F.lit("  x-"), size, F.lit(".5 ")))
    t = t.when(kind == 4, "1,234.50").when(kind == 5, F.col("p_name")).when(kind == 6, F.concat(F.lit("é  label "), s(k % 9))).when(kind == 7, "").when(kind == 8, None)
    t = t.when(kind == 9, "٣٤").when(kind == 10, F.concat(F.lit("INFERRED_"), s(k % 1000))).otherwise(F.concat(s(k % 50), F.lit("B")))
    return derived.read(spark, d, "part").select(k.alias("region"), t.alias("text"), ((k % 100) / 100.0).alias("confidence"))


@query("fn01_normalise", f"WITH {LABELS} SELECT region, trim(regexp_replace(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\\s+', ' ', 'g')) AS normalised FROM labels_in")
def normalise(spark, d):
    return labels_in(spark, d).select("region", text.normalised(text.nfkc("text")).alias("normalised"))


NUM = r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)"
PURE = f"coalesce(regexp_full_match(trim(text), '{NUM}'), false)"


@query("fn04_is_numeric", f"WITH {LABELS} SELECT region, {PURE} AS is_numeric, coalesce(regexp_full_match(trim(text), '\\d+(\\.\\d+)?'), false) AS is_duration FROM labels_in")
def numeric(spark, d):
    c = F.col("text")
    return labels_in(spark, d).select("region", text.is_number(c).alias("is_numeric"), text.is_duration_format(c).alias("is_duration"))


@query("fn05_numbers", f"WITH {LABELS}, n AS (SELECT region, CASE WHEN {PURE} THEN [trim(text)] ELSE regexp_extract_all(text, '{NUM}') END AS found FROM labels_in), v AS (SELECT region, unnest(found) AS raw, unnest(range(len(found))) AS place FROM n) SELECT region, CAST(place AS INTEGER) AS place, CAST(replace(raw, ',', '') AS DOUBLE) AS value FROM v")
def numbers_found(spark, d):
    return labels_in(spark, d).select("region", F.posexplode(text.numbers_in(F.col("text"))).alias("place", "value"))


@query("fn07_pairs", rf"WITH {LABELS} SELECT region, CAST(regexp_extract(text, '(\d+(?:\.\d+)?)\s*[/\-]\s*(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS first, CAST(regexp_extract(text, '(\d+(?:\.\d+)?)\s*[/\-]\s*(\d+(?:\.\d+)?)', 2) AS DOUBLE) AS second FROM labels_in WHERE regexp_matches(text, '(\d+(?:\.\d+)?)\s*[/\-]\s*(\d+(?:\.\d+)?)')")
def pairs(spark, d):
    return labels_in(spark, d).select("region", F.explode(text.pairs_in(F.col("text"))).alias("p")).select("region", "p.first", "p.second")


IDS = r"regexp_full_match(trim(text), '[A-Za-z]\d{1,4}') OR regexp_full_match(trim(text), '[A-Za-z]{1,3}\d{1,4}') OR regexp_full_match(trim(text), '\d{1,4}[A-Za-z]')"
KIND = f"CASE WHEN {PURE} THEN 'numeric' WHEN {IDS} THEN 'activity_id' WHEN length(trim(text)) BETWEEN 2 AND 50 AND regexp_matches(text, '\\p{{L}}') THEN 'text_label' ELSE 'unknown' END"


@query("fn08_text_type", f"WITH {LABELS}, k AS (SELECT *, {KIND} AS kind FROM labels_in) SELECT region, kind, CASE kind WHEN 'numeric' THEN CASE WHEN regexp_full_match(regexp_replace(trim(text), '[.+-]', '', 'g'), '\\d+') THEN least(CASE WHEN confidence > 0 THEN confidence ELSE 0.8 END + 0.1, 1.0) ELSE CASE WHEN confidence > 0 THEN confidence ELSE 0.8 END END WHEN 'activity_id' THEN 0.8 WHEN 'text_label' THEN CASE WHEN length(trim(text)) >= 5 THEN 0.6 ELSE 0.5 END ELSE 0 END::DOUBLE AS type_confidence FROM k")
def text_types(spark, d):
    return labels_in(spark, d).select("region", text.text_type(F.col("text")).alias("kind"), text.type_confidence(F.col("text"), F.col("confidence")).alias("type_confidence"))


@query("fn09_activity_id", rf"WITH {LABELS} SELECT region, CASE WHEN regexp_full_match(trim(text), '[A-Za-z]\d*') OR regexp_full_match(trim(text), '\p{{L}}') OR regexp_full_match(trim(text), '[A-Za-z0-9]{{1,4}}') THEN upper(trim(text)) END AS activity_id FROM labels_in")
def activity_ids(spark, d):
    return labels_in(spark, d).select("region", text.extracted_id(F.col("text")).alias("activity_id"))


@query("fn10_plausible_id", rf"WITH {LABELS} SELECT region, coalesce(NOT (trim(text) = '' OR len(regexp_split_to_array(trim(text), '\s+')) > 2 OR length(trim(text)) > 6 OR regexp_matches(text, '[|\\/\-_=+<>{{}}()\[\]]') OR regexp_matches(text, '[\x{{600}}-\x{{6FF}}]')) AND (regexp_full_match(trim(text), '\p{{L}}') OR regexp_full_match(trim(text), '[A-Za-z]\d{{0,2}}') OR regexp_full_match(trim(text), '\p{{L}}{{1,4}}')), false) AS plausible FROM labels_in")
def plausible(spark, d):
    return labels_in(spark, d).select("region", text.is_plausible_id(F.col("text")).alias("plausible"))


@query("fn11_first_number", rf"WITH {LABELS} SELECT region, coalesce(TRY_CAST(trim(t) AS DOUBLE), TRY_CAST(nullif(regexp_extract(t, '[-+]?\d*\.?\d+'), '') AS DOUBLE)) AS value FROM (SELECT region, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS t FROM labels_in)")
def first_number(spark, d):
    return labels_in(spark, d).select("region", text.first_number(text.digits_to_ascii(F.col("text"))).alias("value"))


#: One character for each part, and the SQL's own statement of the maps.
SIGNS = "0123456789ABCDGIOQSVYZ"
ONE_SIGN = f"signs AS (SELECT p_partkey AS region, CASE WHEN p_partkey % 9 = 0 THEN p_name ELSE substr('{SIGNS}', CAST(p_partkey % {len(SIGNS)} + 1 AS INTEGER), 1) END AS text FROM part)"


def signs(spark, d):
    k = F.col("p_partkey")
    one = F.substring(F.lit(SIGNS), (k % len(SIGNS) + 1).cast("int"), F.lit(1))
    return derived.read(spark, d, "part").select(k.alias("region"), F.when(k % 9 == 0, F.col("p_name")).otherwise(one).alias("text"))


@query("fn12_unconfused", f"WITH {ONE_SIGN} SELECT region, CASE text WHEN '0' THEN 'O' WHEN '1' THEN 'I' WHEN '2' THEN 'Z' WHEN '3' THEN 'B' WHEN '5' THEN 'S' WHEN '6' THEN 'G' WHEN '8' THEN 'B' ELSE text END AS letters FROM signs")
def unconfused(spark, d):
    return signs(spark, d).select("region", text.unconfused(F.col("text")).alias("letters"))


@query("fn12_ambiguous", f"WITH {ONE_SIGN}, m AS (SELECT * FROM (VALUES ('O', '0 D Q'), ('0', 'O D Q'), ('S', '5 8'), ('5', 'S'), ('V', 'Y U'), ('Y', 'V'), ('I', '1 l'), ('1', 'I l'), ('Z', '2'), ('2', 'Z'), ('B', '8'), ('8', 'B'), ('G', '6 C'), ('6', 'G'), ('Q', 'O 0'), ('D', 'O 0')) v(k, v)) SELECT region, coalesce(v, '') AS others FROM signs LEFT JOIN m ON k = text")
def ambiguous(spark, d):
    return signs(spark, d).select("region", F.array_join(text.ambiguous(F.col("text")), " ").alias("others"))


@query("fn12_confusable", f"WITH {ONE_SIGN}, m AS (SELECT * FROM (VALUES ('C', 'G O Q'), ('G', 'C 6'), ('O', 'Q D 0'), ('Q', 'O D'), ('I', 'L 1 l'), ('L', 'I 1'), ('S', '5 8'), ('Z', '2'), ('B', '8 13'), ('D', 'O 0'), ('U', 'V'), ('V', 'U Y'), ('M', 'N'), ('N', 'M')) v(k, v)) SELECT region, coalesce(v, '') AS others FROM signs LEFT JOIN m ON k = upper(text)")
def confusable(spark, d):
    return signs(spark, d).select("region", F.array_join(evidence.confusable(F.col("text")), " ").alias("others"))


@query("fn14_confidence_scale", "SELECT p_partkey AS region, (p_size * 3 - 20) / 100.0 AS confidence FROM part WHERE p_size * 3 - 20 >= 0 AND trim(p_name) <> ''")
def scaled(spark, d):
    raw = F.col("p_size") * 3 - 20
    return derived.read(spark, d, "part").filter((raw >= 0) & (F.trim("p_name") != "")).select(F.col("p_partkey").alias("region"), (raw / 100.0).alias("confidence"))


@query("fn15_angles", f"WITH {BOXES} SELECT a.network_id, a.node_id, round(degrees(atan2(b.y - a.y, b.x - a.x)), 6) AS angle, round(((degrees(atan2(b.y - a.y, b.x - a.x)) % 180) + 180) % 180, 6) AS undirected FROM boxes a JOIN boxes b ON a.network_id = b.network_id AND b.seq = a.seq + 1")
def angles(spark, d):
    boxes = derived.diagram_boxes(spark, d)
    nxt = boxes.select("network_id", (F.col("seq") - 1).alias("seq"), F.col("x").alias("bx"), F.col("y").alias("by"))
    a = F.degrees(F.atan2(F.col("by") - F.col("y"), F.col("bx") - F.col("x")))
    return boxes.join(nxt, ["network_id", "seq"]).select("network_id", "node_id", F.round(a, 6).alias("angle"), F.round(F.pmod(a, F.lit(180.0)), 6).alias("undirected"))


@query("fn20_report_id", f"WITH {NETWORKS} SELECT DISTINCT network_id, substr(sha256(CAST(network_id AS VARCHAR)), 1, 12) AS report_id FROM activities")
def report_id(spark, d):
    return derived.activities(spark, d).select("network_id").distinct().withColumn("report_id", F.substring(F.sha2(F.col("network_id").cast("string"), 256), 1, 12))


@query("pr29_plain_numbers", "SELECT l_orderkey, l_linenumber, l_extendedprice, regexp_replace(printf('%.6f', l_extendedprice), '\\.?0+$', '') AS written FROM lineitem")
def plain(spark, d):
    return derived.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", numbers.plain_number(F.col("l_extendedprice")).alias("written"))


@query("fn16_half_even", "SELECT p_partkey, round_even(p_retailprice / 8, 2)::DOUBLE AS rounded FROM part")
def half_even(spark, d):
    return derived.read(spark, d, "part").select("p_partkey", numbers.half_even(F.col("p_retailprice") / 8, 2).alias("rounded"))


# --- evidence -----------------------------------------------------------------------------

EV = lambda own, other: f"greatest(0.0, {own} * 1.0 / n * 0.4 + CASE WHEN {own} >= 3 THEN 0.3 WHEN {own} >= 2 THEN 0.2 WHEN {own} >= 1 THEN 0.1 ELSE 0 END - CASE WHEN {other} > {own} THEN 0.2 WHEN {other} > 0 THEN 0.1 ELSE 0 END + CASE WHEN cv < 0.3 AND {own} >= 2 THEN 0.15 ELSE 0 END)"


@query("ev01_diagram_type", f"WITH {BOXES}, c AS (SELECT network_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (shape_type = 'rectangle') AS r, count(*) FILTER (shape_type = 'circle') AS o, stddev_pop(width * height) / avg(width * height) AS cv FROM boxes GROUP BY network_id), e AS (SELECT *, {EV('r', 'o')} AS aon, {EV('o', 'r')} AS aoa FROM c) SELECT network_id, CASE WHEN n < 2 THEN 'UNKNOWN' WHEN aon > aoa AND aon / (aon + aoa) > 0.3 THEN 'AON' WHEN aoa > aon AND aoa / (aon + aoa) > 0.3 THEN 'AOA' ELSE 'UNKNOWN' END AS diagram_type, round(greatest(aon, aoa) / (aon + aoa), 6) AS confidence FROM e")
def diagram_types(spark, d):
    counts = shape_counts(spark, d).join(size_stats(spark, d), "network_id")
    return evidence.diagram_types(counts).withColumn("confidence", F.round("confidence", 6))


OCR = """ocr AS (SELECT p_partkey AS node_id, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 5 THEN 'Q9' ELSE chr(CAST(97 + p_partkey % 26 AS INTEGER)) END AS raw, (p_partkey % 97) / 100.0::DOUBLE AS confidence,
  chr(CAST(65 + (p_partkey * 7) % 26 AS INTEGER)) AS alt1, ((p_partkey * 13) % 60) / 100.0::DOUBLE AS c1, CASE WHEN p_partkey % 4 = 0 THEN '12' ELSE chr(CAST(65 + (p_partkey * 11) % 26 AS INTEGER)) END AS alt2, ((p_partkey * 17) % 60) / 100.0::DOUBLE AS c2 FROM part)"""
OCR_BEST = f"""WITH {OCR}, b AS (SELECT *, CASE WHEN c1 >= 0.3 AND (NOT (c2 >= 0.3 AND alt2 <> '12') OR c1 > c2 OR (c1 = c2 AND alt1 <= alt2)) THEN alt1 WHEN c2 >= 0.3 AND alt2 <> '12' THEN alt2 END AS best, regexp_full_match(upper(raw), '[A-Z]') AS valid FROM ocr),
r AS (SELECT node_id, confidence, CASE WHEN raw IS NULL THEN NULL WHEN confidence >= 0.7 THEN upper(raw) WHEN best IS NOT NULL THEN best WHEN valid THEN upper(raw) END AS resolved_id,
  CASE WHEN raw IS NULL THEN 'REVIEW_REQUIRED' WHEN confidence >= 0.7 THEN 'CONFIRMED' WHEN best IS NOT NULL THEN 'CONTEXTUALLY_RESOLVED' WHEN valid THEN 'CONFIRMED' ELSE 'REVIEW_REQUIRED' END AS status FROM b)"""


def ocr(spark, d):
    k = F.col("p_partkey")
    letter = lambda base, v: F.expr(f"char({base} + {v} % 26)")
    raw = F.when(k % 6 == 0, None).when(k % 6 == 5, "Q9").otherwise(letter(97, "p_partkey"))
    first = F.struct(letter(65, "(p_partkey * 7)").alias("id"), ((k * 13) % 60 / 100.0).alias("confidence"))
    second = F.struct(F.when(k % 4 == 0, "12").otherwise(letter(65, "(p_partkey * 11)")).alias("id"), ((k * 17) % 60 / 100.0).alias("confidence"))
    return derived.read(spark, d, "part").select(k.alias("node_id"), k.alias("seq"), raw.alias("raw"), (k % 97 / 100.0).alias("confidence"), F.array(first, second).alias("alternatives"))


@query("ev11_resolved_ids", f"{OCR_BEST} SELECT node_id, resolved_id, status FROM r")
def resolved_ids(spark, d):
    return evidence.resolved_ids(ocr(spark, d)).drop("source")


#: The fold over the holders of one id as a recursion; alternatives stand in order of confidence.
UNIQUE = OCR_BEST.replace("WITH ocr", "WITH RECURSIVE ocr") + """, c AS (SELECT o.node_id // 40 AS network_id, o.node_id, r.resolved_id, r.status, coalesce(r.resolved_id, upper(o.raw)) AS claim, r.confidence,
  CASE WHEN alt2 = '12' THEN [alt1] WHEN c1 >= c2 THEN [alt1, alt2] ELSE [alt2, alt1] END AS options FROM ocr o JOIN r USING (node_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY network_id, claim ORDER BY confidence DESC, node_id) AS k FROM c WHERE claim IS NOT NULL),
f AS (SELECT network_id, claim, k, node_id, resolved_id, status, CASE WHEN resolved_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE [resolved_id] END AS used FROM k WHERE k = 1
  UNION ALL SELECT network_id, claim, k, node_id, pick, CASE WHEN pick IS NULL THEN 'REVIEW_REQUIRED' ELSE 'CONTEXTUALLY_RESOLVED' END, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (SELECT f.network_id, f.claim, n.k, n.node_id, f.used, list_filter(n.options, lambda o: NOT list_contains(f.used, o))[1] AS pick FROM f JOIN k n ON n.network_id = f.network_id AND n.claim = f.claim AND n.k = f.k + 1))
SELECT network_id, node_id, resolved_id, status FROM f UNION ALL SELECT network_id, node_id, resolved_id, status FROM c WHERE claim IS NULL"""


@query("ev12_unique_ids", UNIQUE)
def unique_ids(spark, d):
    rows = ocr(spark, d).withColumn("network_id", F.expr("node_id div 40"))
    resolved = evidence.resolved_ids(rows).join(rows.select("network_id", "node_id", "seq", "raw", "confidence", "alternatives"), "node_id")
    return evidence.unique_ids(resolved).select("network_id", "node_id", "resolved_id", "status")


@query("ag25_resolution_counts", f"{OCR_BEST} SELECT status, count(*) AS n FROM r GROUP BY status")
def resolution_counts(spark, d):
    return evidence.resolved_ids(ocr(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


DUR = """dur AS (SELECT l_orderkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS seq, l_quantity / 2 AS value,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(CAST(floor(l_quantity / 2) AS BIGINT) AS VARCHAR) ELSE 'x' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS raw_text, l_discount * 10 AS confidence, l_linenumber % 2 = 0 AS in_sub_crop FROM lineitem)"""
DUR_SCORE = "round(least(confidence, 1.0) * 0.3 + CASE WHEN regexp_full_match(trim(raw_text), '\\d+(\\.\\d+)?') THEN 0.2 ELSE 0 END + CASE WHEN value > 0 AND value <= 20 THEN 0.2 ELSE 0 END + CASE WHEN value = floor(value) THEN 0.1 ELSE 0 END + CASE WHEN trim(raw_text) = CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END THEN 0.1 ELSE 0 END + CASE WHEN in_sub_crop THEN 0.1 ELSE 0 END, 9)"


@query("ev13_resolved_durations", f"WITH {DUR}, s AS (SELECT *, {DUR_SCORE} AS score FROM dur), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, seq) AS k FROM s) SELECT node_id, value AS resolved_value, score, CASE WHEN score >= 0.6 THEN 'CONFIRMED' WHEN score >= 0.3 THEN 'CONTEXTUALLY_RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status FROM r WHERE k = 1")
def resolved_durations(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = derived.read(spark, d, "lineitem").withColumn("seq", F.row_number().over(order))
    half = F.col("l_quantity") / 2
    raw = F.when(F.col("l_partkey") % 3 == 0, half.cast("long").cast("string")).otherwise(F.concat(F.lit("x"), F.col("l_quantity").cast("long").cast("string")))
    return evidence.resolved_durations(rows.select(F.col("l_orderkey").alias("node_id"), "seq", half.alias("value"), raw.alias("raw_text"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_linenumber") % 2 == 0).alias("in_sub_crop")))


STAGES = """m AS (SELECT o_orderkey AS image, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 60 END AS nodes, o_orderkey % 50 AS raw_shapes, o_orderkey % 17 AS dups, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 3) % 90 END AS acts,
  (o_orderkey * 5) % 9 AS arrows, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 7) % 8 END AS dedup, (o_orderkey * 11) % 4 AS vdeps, (o_orderkey * 13) % 5 AS rdeps, o_orderkey % 3 AS regions, o_orderkey % 6 AS labels,
  CASE WHEN o_orderkey % 2 = 0 THEN 'AON' ELSE 'AOA' END AS kind, o_orderkey % 4 <> 0 AS valid, CASE WHEN o_orderkey % 8 = 0 THEN 'BLOCKED_REVIEW' ELSE 'RUNNABLE' END AS gate FROM orders)"""
FIRST_STAGE = f"""WITH {STAGES}, c AS (SELECT *, coalesce(acts >= 40, false) AND (NOT coalesce(nodes >= 40, false) OR coalesce(acts > nodes * 2, false)) AS by_count, coalesce(nodes >= 40, false) AS many, CASE WHEN raw_shapes > 0 THEN dups * 1.0 / raw_shapes END AS share,
  coalesce(nodes > 0, false) AS present FROM m),
k AS (SELECT image, CASE WHEN by_count AND kind = 'AOA' THEN 'Detecting arrows|ARROW_DETECTION' WHEN by_count THEN 'Reconstructing diagram|NODE_RECONSTRUCTION'
  WHEN many AND (share IS NULL OR share < 0.25) THEN 'Detecting shapes|SHAPE_DETECTION' WHEN many THEN 'Detecting shapes|SHAPE_DEDUPLICATION'
  WHEN present AND (arrows = 0 OR coalesce(dedup = 0, false)) THEN 'Detecting arrows|ARROW_DETECTION'
  WHEN present AND (vdeps = 0 OR rdeps = 0) THEN CASE WHEN labels > 0 THEN 'Associating text|' ELSE 'Building graph|' END || CASE WHEN dedup IS NULL THEN 'ARROW_DETECTION' ELSE 'NODE_PAIRING' END
  WHEN present AND coalesce(acts > 0, false) AND (NOT valid OR gate = 'BLOCKED_REVIEW') AND labels = 0 AND regions = 0 THEN 'Extracting text (OCR)|OCR'
  WHEN present AND coalesce(acts > 0, false) AND (NOT valid OR gate = 'BLOCKED_REVIEW') AND labels > 0 AND acts > labels * 3 THEN 'Associating text|OCR'
  WHEN NOT valid THEN 'Building graph|GRAPH_BUILD' ELSE '|UNKNOWN' END AS v FROM c),
classified AS (SELECT image, nullif(split_part(v, '|', 1), '') AS stage, split_part(v, '|', 2) AS failure_class FROM k)"""


def stage_metrics(spark, d):
    k = F.col("o_orderkey")
    return derived.read(spark, d, "orders").select(
        k.alias("image"), F.when(k % 7 != 0, k % 60).alias("final_candidate_nodes"), (k % 50).alias("raw_shapes"), (k % 17).alias("duplicates_suppressed"),
        F.when(k % 11 != 0, (k * 3) % 90).alias("reconstructed_activities"), ((k * 5) % 9).alias("arrows_detected"), F.when(k % 5 != 0, (k * 7) % 8).alias("deduplicated_arrows"),
        ((k * 11) % 4).alias("validated_dependencies"), ((k * 13) % 5).alias("reconstructed_dependencies"), (k % 3).alias("ocr_regions"), (k % 6).alias("ocr_labels"),
        F.when(k % 2 == 0, "AON").otherwise("AOA").alias("diagram_type"), (k % 4 != 0).alias("graph_is_valid"), F.when(k % 8 == 0, "BLOCKED_REVIEW").otherwise("RUNNABLE").alias("cpm_gate"),
    )


@query("va17_first_abnormal_stage", f"{FIRST_STAGE} SELECT * FROM classified")
def first_stage(spark, d):
    return evidence.first_abnormal_stage(stage_metrics(spark, d)).select("image", "stage", "failure_class")


@query("ag10_bottlenecks", f"{FIRST_STAGE} SELECT failure_class, count(*) AS image_count FROM classified GROUP BY ALL")
def bottlenecks(spark, d):
    return evidence.bottlenecks(evidence.first_abnormal_stage(stage_metrics(spark, d)))


RUNS = "runs AS (SELECT o_orderkey AS image, o_orderkey % 13 = 0 AS errors, o_orderkey % 3 = 0 AS review, o_orderkey % 2 = 0 AS validated FROM orders), f AS (SELECT image, CASE WHEN errors THEN 'FAILED' WHEN review THEN 'REVIEW_REQUIRED' WHEN validated THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM runs), o AS (SELECT *, CASE status WHEN 'FAILED' THEN 'FATAL_FAILURE' WHEN 'SUCCESS' THEN 'AUTOMATIC_SUCCESS' ELSE 'AUTOMATIC_REVIEW_REQUIRED' END AS outcome FROM f)"


def run_status(spark, d):
    k = F.col("o_orderkey")
    rows = derived.read(spark, d, "orders").select(k.alias("image"), evidence.final_status((k % 13 == 0).cast("int"), k % 3 == 0, k % 2 == 0).alias("status"))
    return rows.withColumn("outcome", evidence.outcome(F.col("status")))


@query("va15_final_status", f"WITH {RUNS} SELECT image, status, outcome FROM o")
def final_status(spark, d):
    return run_status(spark, d)


@query("ag11_benchmark_summary", f"WITH {RUNS} SELECT outcome, status, count(*) AS images FROM o GROUP BY ALL")
def benchmark_summary(spark, d):
    return run_status(spark, d).groupBy("outcome", "status").agg(F.count("*").alias("images"))


@query("va18_readiness", "SELECT o_orderkey AS session, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'REVIEW_REQUIRED' ELSE 'NO_ANALYSIS' END WHEN o_orderkey % 7 > 4 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'REVIEW_REQUIRED' WHEN o_orderkey % 3 = 0 THEN 'GRAPH_INVALID' WHEN o_orderkey % 4 = 0 THEN 'CPM_BLOCKED' WHEN o_orderkey % 17 = 0 THEN 'RESULT_UNAVAILABLE' ELSE 'READY' END AS readiness FROM orders")
def readiness(spark, d):
    k = F.col("o_orderkey")
    rows = derived.read(spark, d, "orders").select(
        k.alias("session"), (k % 5 != 0).alias("has_candidate"), (k % 2 == 0).alias("has_workflow"), F.greatest(F.lit(0), k % 7 - 4).alias("pending"), (k % 11 == 0).alias("dirty"),
        F.when(k % 13 != 0, k % 3 != 0).alias("is_valid"), F.when(k % 4 != 0, "RUNNABLE").alias("gate"), (k % 17 != 0).alias("has_cpm"),
    )
    return rows.select("session", evidence.readiness(rows).alias("readiness"))


# --- metrics ------------------------------------------------------------------------------

DETECTED = f"""WITH {NETWORKS}, detected AS (SELECT network_id, CASE WHEN (s + t) % 7 = 0 THEN target ELSE source END AS source, CASE WHEN (s + t) % 7 = 0 THEN source ELSE target END AS target FROM dependencies WHERE (s + t) % 5 <> 0
  UNION ALL SELECT network_id, activity_id, 'N01' FROM activities WHERE seq = 4)"""
EDGE_ACC = f"""{DETECTED}, b AS (SELECT network_id, source, target, max(t) AS t, max(d) AS d FROM (SELECT DISTINCT network_id, source, target, 1 AS t, 0 AS d FROM dependencies UNION ALL SELECT DISTINCT network_id, source, target, 0, 1 FROM detected) GROUP BY ALL),
p AS (SELECT network_id, least(source, target) AS lo, greatest(source, target) AS hi, sum(t) AS t, sum(d) AS d, sum(t * d) AS tp FROM b GROUP BY ALL),
n AS (SELECT network_id, sum(tp) AS tp, sum(t) AS e, sum(d) AS f, count(*) FILTER (t > 0 AND d > 0) AS ptp, count(*) FILTER (t > 0) AS pe, count(*) FILTER (d > 0) AS pf, count(*) FILTER (t > 0 AND d > 0 AND tp > 0) AS ok FROM p GROUP BY ALL)"""


def _prf(tp: str, det: str, exp: str) -> tuple[str, str, str]:
    p, r = f"({tp} / nullif({det}, 0))::DOUBLE", f"({tp} / nullif({exp}, 0))::DOUBLE"
    return f"round_even({p}, 4)", f"round_even({r}, 4)", f"round_even(CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 4)"


def detected_edges(spark, d):
    acts, deps = nets(spark, d)
    s, t = (F.substring(c, 2, 2).cast("int") for c in ("source", "target"))
    turn = (s + t) % 7 == 0
    kept = deps.filter((s + t) % 5 != 0).select("network_id", F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target"))
    return deps, kept.unionByName(acts.filter("seq = 4").select("network_id", F.col("activity_id").alias("source"), F.lit("N01").alias("target")))


P, R, F1 = _prf("tp", "f", "e")
UP, UR, UF = _prf("ptp", "pf", "pe")


@query("ag08_edge_accuracy", f"{EDGE_ACC} SELECT network_id, CAST(e AS BIGINT) AS expected_edges, CAST(f AS BIGINT) AS detected_edges, {P} AS precision, {R} AS recall, {F1} AS f1, {UP} AS pair_precision, {UR} AS pair_recall, {UF} AS pair_f1, round_even((ok / nullif(ptp, 0))::DOUBLE, 4) AS direction_accuracy FROM n")
def edge_accuracy(spark, d):
    return metrics.edge_accuracy(*detected_edges(spark, d))


@query("st02_edge_sets", f"{DETECTED} SELECT network_id, source, target, 'TP' AS kind FROM (SELECT DISTINCT network_id, source, target FROM dependencies INTERSECT SELECT DISTINCT network_id, source, target FROM detected) UNION ALL SELECT network_id, source, target, 'FP' FROM (SELECT network_id, source, target FROM detected EXCEPT SELECT network_id, source, target FROM dependencies) UNION ALL SELECT network_id, source, target, 'FN' FROM (SELECT network_id, source, target FROM dependencies EXCEPT SELECT network_id, source, target FROM detected)")
def edge_sets(spark, d):
    truth, found = detected_edges(spark, d)
    t, f = truth.select("network_id", "source", "target"), found.select("network_id", "source", "target")
    kind = lambda rows, name: rows.withColumn("kind", F.lit(name))
    return kind(t.intersect(f), "TP").unionByName(kind(f.subtract(t), "FP")).unionByName(kind(t.subtract(f), "FN"))


@query("st03_undirected_edges", f"{DETECTED} SELECT DISTINCT network_id, least(source, target) AS low, greatest(source, target) AS high FROM detected")
def undirected(spark, d):
    return detected_edges(spark, d)[1].select("network_id", F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")).distinct()


MATCHED = f"WITH {NETWORKS}, matched AS (SELECT network_id, CASE WHEN seq % 9 = 0 THEN 0 ELSE duration END AS truth, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 4 = 0 THEN duration + 1 ELSE duration END AS detected, activity_id AS truth_id, CASE WHEN seq % 3 = 0 THEN lower(activity_id) || ' ' WHEN seq % 4 = 0 THEN 'Z' ELSE activity_id END AS detected_id FROM activities)"


def matched(spark, d):
    s, q, i = F.col("seq"), F.col("duration"), F.col("activity_id")
    return derived.activities(spark, d).select(
        "network_id", F.when(s % 9 == 0, 0.0).otherwise(q).alias("truth"), F.when(s % 5 == 0, None).when(s % 4 == 0, q + 1).otherwise(q).alias("detected"),
        i.alias("truth_id"), F.when(s % 3 == 0, F.concat(F.lower(i), F.lit(" "))).when(s % 4 == 0, "Z").otherwise(i).alias("detected_id"),
    )


@query("ag06_duration_accuracy", f"{MATCHED}, e AS (SELECT *, abs(truth - detected) AS err FROM matched WHERE truth IS NOT NULL AND detected IS NOT NULL) SELECT network_id, count(*) AS compared, count(*) FILTER (err < 1e-9) AS exact_matches, round_even((count(*) FILTER (err < 1e-9) / count(*))::DOUBLE, 4) AS exact_match_accuracy, round_even(avg(err), 4) AS mean_abs_error, round_even(avg(CASE WHEN truth <> 0 THEN err / abs(truth) END), 4) AS mean_relative_error FROM e GROUP BY network_id")
def duration_accuracy(spark, d):
    return metrics.duration_accuracy(matched(spark, d))


@query("ag07_id_accuracy", f"{MATCHED} SELECT network_id, count(*) AS compared, round_even(avg(CASE WHEN lower(trim(truth_id)) = lower(trim(detected_id)) THEN 1.0 ELSE 0.0 END), 4) AS id_accuracy FROM matched GROUP BY network_id")
def id_accuracy(spark, d):
    return metrics.id_accuracy(matched(spark, d))


@query("ag12_mean_metrics", f"{EDGE_ACC}, a AS (SELECT network_id % 3 AS kind, {P} AS p, {R} AS r, round_even((ok / nullif(ptp, 0))::DOUBLE, 4) AS da FROM n) SELECT kind, round(avg(p), 3) AS precision, round(avg(r), 3) AS recall, count(da) AS direction_accuracy_count FROM a GROUP BY kind")
def mean_metrics(spark, d):
    acc = metrics.edge_accuracy(*detected_edges(spark, d)).withColumn("kind", F.col("network_id") % 3)
    return acc.groupBy("kind").agg(F.round(F.avg("precision"), 3).alias("precision"), F.round(F.avg("recall"), 3).alias("recall"), F.count("direction_accuracy").alias("direction_accuracy_count"))


NP, NR, NF = _prf("tp", "found", "expected")


@query("ag05_node_prf", f"WITH {NETWORKS}, c AS (SELECT network_id, CAST(count(*) AS DOUBLE) AS expected, CAST(count(*) FILTER (seq % 4 <> 0) + 1 AS DOUBLE) AS found, CAST(count(*) FILTER (seq % 4 <> 0) AS DOUBLE) AS tp FROM activities GROUP BY ALL) SELECT network_id, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found, CAST(tp AS BIGINT) AS tp, {NP} AS precision, {NR} AS recall, {NF} AS f1 FROM c")
def node_prf(spark, d):
    acts = derived.activities(spark, d)
    hit = acts.filter("seq % 4 <> 0").select("network_id", "activity_id")
    extra = acts.select("network_id").distinct().withColumn("activity_id", F.lit("dX"))
    return metrics.node_accuracy(acts, hit.unionByName(extra), hit)


# --- review -------------------------------------------------------------------------------

SETTLED = f"""WITH {DECISIONS}, e AS (SELECT * FROM decisions WHERE decision IN ('ACCEPT', 'REJECT') OR (decision = 'CORRECT' AND corrected_value IS NOT NULL)),
s AS (SELECT item_id, CASE decision WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'CORRECT' THEN 'CORRECTED' ELSE 'REJECTED' END AS status, corrected_value FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts, seq) AS k FROM e) WHERE k = 1),
v AS (SELECT item_id, max(seq) * 1.0::DOUBLE AS value FROM decisions GROUP BY ALL)"""


def review_values(spark, d):
    log = derived.decisions(spark, d)
    return log.groupBy("item_id").agg(F.max("seq").cast("double").alias("value")), log


@query("hr02_settled_items", f"{SETTLED} SELECT v.item_id, coalesce(s.status, 'PENDING') AS status, s.corrected_value FROM v LEFT JOIN s USING (item_id)")
def settled(spark, d):
    values, log = review_values(spark, d)
    return review.statuses(values, log).select("item_id", "status", "corrected_value")


@query("hr05_review_summary", f"{SETTLED} SELECT coalesce(s.status, 'PENDING') AS status, count(*) AS items FROM v LEFT JOIN s USING (item_id) GROUP BY ALL")
def review_summary(spark, d):
    return review.summary(*review_values(spark, d))


@query("jn18_review_overlay", f"{SETTLED} SELECT v.item_id, CASE WHEN s.status = 'CORRECTED' THEN s.corrected_value ELSE v.value END AS value, coalesce(s.status, 'PENDING') AS status FROM v LEFT JOIN s USING (item_id) WHERE coalesce(s.status, '') <> 'REJECTED'")
def overlay(spark, d):
    return review.overlay(*review_values(spark, d))


EDGE_LOG = f"""WITH {NETWORKS}, edges AS (SELECT CAST(network_id AS VARCHAR) || ':' || source || '>' || target AS item_id, network_id, source, target FROM dependencies),
log AS (SELECT item_id, seq, decision, new_end FROM (SELECT item_id, 1 AS seq, CASE network_id % 6 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'REVERSE' WHEN 2 THEN 'CHANGE_SOURCE' WHEN 3 THEN 'CHANGE_TARGET' WHEN 4 THEN 'ACCEPT' END AS decision, 'X01' AS new_end FROM edges UNION ALL SELECT item_id, 2, 'REJECT', NULL FROM edges WHERE network_id % 6 <> 5) WHERE decision IS NOT NULL),
f AS (SELECT item_id, min_by(decision, seq) AS decision, min_by(new_end, seq) AS new_end FROM log GROUP BY item_id),
after AS (SELECT e.item_id, CASE f.decision WHEN 'REVERSE' THEN e.target WHEN 'CHANGE_SOURCE' THEN f.new_end ELSE e.source END AS source, CASE f.decision WHEN 'REVERSE' THEN e.source WHEN 'CHANGE_TARGET' THEN f.new_end ELSE e.target END AS target, coalesce(f.decision, 'PENDING') AS decision FROM edges e LEFT JOIN f USING (item_id) WHERE coalesce(f.decision, '') <> 'REJECT')"""


@query("hr03_decided_edges", f"{EDGE_LOG} SELECT item_id, source, target, decision FROM after")
def decided_edges(spark, d):
    deps = nets(spark, d)[1]
    edges = deps.withColumn("item_id", F.concat(F.col("network_id").cast("string"), F.lit(":"), "source", F.lit(">"), "target"))
    k = (F.col("network_id") % 6).cast("int")
    first = F.when(k == 0, "REJECT").when(k == 1, "REVERSE").when(k == 2, "CHANGE_SOURCE").when(k == 3, "CHANGE_TARGET").when(k == 4, "ACCEPT")
    log = edges.select("item_id", F.lit(1).alias("seq"), first.alias("decision"), F.lit("X01").alias("new_end"), F.current_timestamp().alias("ts")).unionByName(
        edges.filter(k != 5).select("item_id", F.lit(2).alias("seq"), F.lit("REJECT").alias("decision"), F.lit(None).cast("string").alias("new_end"), F.current_timestamp().alias("ts"))
    )
    return review.decided_edges(edges, log.filter("decision is not null"))


@query("st07_merged_edges", f"{DETECTED}, a AS (SELECT DISTINCT network_id, source, target FROM dependencies), r AS (SELECT network_id, source, target, count(*) AS n FROM detected GROUP BY ALL) SELECT coalesce(a.network_id, r.network_id) AS network_id, coalesce(a.source, r.source) AS source, coalesce(a.target, r.target) AS target, CASE WHEN r.n > 0 THEN 'review' ELSE 'automatic' END AS origin, coalesce(r.n > 1, false) AS is_conflict FROM a FULL JOIN r ON a.network_id = r.network_id AND a.source = r.source AND a.target = r.target")
def merged_edges(spark, d):
    return review.merged_edges(*detected_edges(spark, d), ["network_id", "source", "target"])


# --- event networks, reports --------------------------------------------------------------

AOA = """arrows AS (SELECT l_orderkey AS network_id, 'N' || lpad(CAST(seq AS VARCHAR), 2, '0') AS activity_id, seq AS from_event, CASE WHEN seq % 4 = 0 THEN seq - 1 ELSE seq + 1 + seq % 2 END AS to_event, 0.5 + l_discount AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS seq FROM lineitem)),
dep AS (SELECT p.network_id, p.activity_id AS source, s.activity_id AS target, min(least(p.confidence, s.confidence)) AS confidence FROM arrows p JOIN arrows s ON p.network_id = s.network_id AND p.to_event = s.from_event AND p.activity_id <> s.activity_id GROUP BY ALL)"""


@query("jn14_event_precedence", f"WITH {AOA} SELECT d.network_id, d.source, d.target, d.confidence, r.network_id IS NOT NULL AS needs_review FROM dep d LEFT JOIN dep r ON r.network_id = d.network_id AND r.source = d.target AND r.target = d.source")
def event_precedence(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = derived.read(spark, d, "lineitem").withColumn("seq", F.row_number().over(order))
    s = F.col("seq")
    arrows = rows.select(F.col("l_orderkey").alias("network_id"), F.concat(F.lit("N"), F.lpad(s.cast("string"), 2, "0")).alias("activity_id"), s.alias("from_event"), F.when(s % 4 == 0, s - 1).otherwise(s + 1 + s % 2).alias("to_event"), (0.5 + F.col("l_discount")).alias("confidence"))
    return report.event_precedence(arrows)


@query("rp02_long_report", f"{CPM}, s AS (SELECT * FROM cpm) SELECT network_id, 'cpm' AS section, activity_id, name, regexp_replace(printf('%.6f', value), '\\.?0+$', '') AS value FROM (SELECT network_id, activity_id, 'early_start' AS name, early_start AS value FROM s UNION ALL SELECT network_id, activity_id, 'early_finish', early_finish FROM s UNION ALL SELECT network_id, activity_id, 'late_start', late_start FROM s UNION ALL SELECT network_id, activity_id, 'late_finish', late_finish FROM s UNION ALL SELECT network_id, activity_id, 'total_float', total_float FROM s UNION ALL SELECT network_id, activity_id, 'free_float', free_float FROM s)")
def long_report(spark, d):
    acts, deps = nets(spark, d)
    return report.long_form(schedule.schedule(acts, deps), "cpm", ["early_start", "early_finish", "late_start", "late_finish", "total_float", "free_float"])


@query("ag28_report_summary", f"{CPM}, d AS (SELECT network_id, count(*) AS n FROM dependencies GROUP BY ALL) SELECT c.network_id, count(*) AS activity_count, coalesce(max(d.n), 0) AS dependency_count, max(project_duration) AS project_duration, count(*) FILTER (is_critical) AS critical_count FROM cpm c LEFT JOIN d USING (network_id) GROUP BY c.network_id")
def report_summary(spark, d):
    acts, deps = nets(spark, d)
    return report.summary(schedule.schedule(acts, deps), deps)


@query("sc06_csv_rows", f"WITH {NETWORKS}, p AS (SELECT network_id, target AS activity_id, string_agg(source, ' ' ORDER BY source) AS predecessors FROM dependencies GROUP BY ALL) SELECT a.network_id, a.activity_id, a.duration, coalesce(p.predecessors, '') AS predecessors FROM activities a LEFT JOIN p USING (network_id, activity_id)")
def csv_rows(spark, d):
    from slackline.sources import csv_networks

    return csv_networks.export_rows(*nets(spark, d)).select("network_id", "activity_id", F.col("duration").cast("double").alias("duration"), F.coalesce("predecessors", F.lit("")).alias("predecessors"))


@query("jn21_results_table", f"{CPM}, p AS (SELECT network_id, target AS activity_id, string_agg(source, ' ' ORDER BY source) AS predecessors FROM dependencies GROUP BY ALL) SELECT c.network_id, c.activity_id, c.duration, c.early_start, c.late_finish, c.is_critical, coalesce(p.predecessors, '') AS predecessors FROM cpm c LEFT JOIN p USING (network_id, activity_id)")
def results_table(spark, d):
    acts, deps = nets(spark, d)
    return report.results(schedule.schedule(acts, deps), deps).select("network_id", "activity_id", "duration", "early_start", "late_finish", "is_critical", F.array_join("predecessors", " ").alias("predecessors"))
