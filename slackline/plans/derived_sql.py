"""The derived inputs of derived.py as DuckDB common table expressions."""

ACTIVITIES = """activities AS (
  SELECT l_orderkey AS network_id, 'N' || lpad(CAST(seq AS VARCHAR), 2, '0') AS activity_id, CAST(seq AS INTEGER) AS seq,
         l_quantity AS duration, l_quantity * 0.5 AS optimistic_time, l_quantity AS most_likely_time, l_quantity * (2 + l_tax) AS pessimistic_time
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS seq FROM lineitem))"""
DEPENDENCIES = """dependencies AS (
  SELECT a.network_id, a.activity_id AS source, b.activity_id AS target, a.seq AS s, b.seq AS t
  FROM activities a JOIN activities b ON a.network_id = b.network_id
  WHERE (b.seq = a.seq + 1 AND a.seq % 3 <> 0) OR b.seq = a.seq + 2 OR (b.seq = a.seq + 3 AND a.seq % 2 = 0))"""
NETWORKS = f"{ACTIVITIES}, {DEPENDENCIES}"
DIRTY = f"""{NETWORKS}, dirty_activities AS (
  SELECT network_id, CASE WHEN network_id % 71 = 0 AND seq = 2 THEN '' ELSE activity_id END AS activity_id, seq,
         CASE WHEN network_id % 89 = 0 AND seq = 1 THEN NULL ELSE duration END AS duration FROM activities),
firsts AS (SELECT DISTINCT network_id FROM dependencies WHERE source = 'N01'),
dirty_dependencies AS (
  SELECT network_id, source, target FROM dependencies
  UNION ALL SELECT network_id, target, source FROM dependencies WHERE network_id % 97 = 0 AND source = 'N01'
  UNION ALL SELECT network_id, 'N01', 'X99' FROM firsts WHERE network_id % 83 = 0
  UNION ALL SELECT network_id, 'N01', 'N01' FROM firsts WHERE network_id % 79 = 0
  UNION ALL SELECT network_id, source, target FROM dependencies WHERE network_id % 73 = 0 AND source = 'N01')"""


def _c(k: int) -> str:
    return f"CAST(embedding[{k}] AS DOUBLE)"


BOXES = f"""boxes AS (
  SELECT vec_id // 25 AS network_id, 'B' || lpad(CAST(vec_id % 25 AS VARCHAR), 2, '0') AS node_id, CAST(vec_id % 25 AS INTEGER) AS seq,
         CASE label % 3 WHEN 0 THEN 'circle' WHEN 1 THEN 'rectangle' ELSE 'polygon' END AS shape_type,
         round(500 + 1500 * {_c(1)}, 3) AS x, round(400 + 1200 * {_c(2)}, 3) AS y,
         round(60 + 200 * abs({_c(3)}), 3) AS width, round(40 + 150 * abs({_c(4)}), 3) AS height, round(0.3 + abs({_c(5)}), 4) AS confidence
  FROM embeddings)"""
SEGMENTS = f"""segments AS (
  SELECT vec_id // 25 AS network_id, 'S' || lpad(CAST(vec_id % 25 AS VARCHAR), 2, '0') AS segment_id, CAST(vec_id % 25 AS INTEGER) AS seq,
         round(500 + 1500 * {_c(6)}, 3) AS x1, round(400 + 1200 * {_c(7)}, 3) AS y1, round(500 + 1500 * {_c(8)}, 3) AS x2, round(400 + 1200 * {_c(9)}, 3) AS y2,
         round(greatest(0.0, 4 * {_c(10)}), 4) AS head_conf, round(0.3 + abs({_c(11)}), 4) AS confidence
  FROM embeddings)"""
REGIONS = f"""regions AS (
  SELECT vec_id // 25 AS network_id, 'T' || lpad(CAST(vec_id % 25 AS VARCHAR), 2, '0') AS region_id, CAST(vec_id % 25 AS INTEGER) AS seq,
         CASE WHEN vec_id % 2 = 0 THEN 'A' || CAST(vec_id % 7 AS VARCHAR) ELSE CAST(vec_id % 11 AS VARCHAR) END AS text,
         round(500 + 1500 * {_c(12)}, 3) AS x, round(400 + 1200 * {_c(13)}, 3) AS y, round(20 + 60 * abs({_c(14)}), 3) AS width, round(10 + 30 * abs({_c(15)}), 3) AS height,
         round(0.3 + abs({_c(16)}), 4) AS confidence
  FROM embeddings)"""
DECISIONS = """decisions AS (
  SELECT event_id AS seq, 'I' || CAST(user_id AS VARCHAR) AS item_id,
         CASE event_id % 5 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'CORRECT' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'LEAVE_UNRESOLVED' ELSE 'COMMENT' END AS decision,
         ts, CASE WHEN event_id % 5 = 1 THEN round(value, 2) END AS corrected_value FROM events)"""
