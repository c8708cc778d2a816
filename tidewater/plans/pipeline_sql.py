"""The same results in SQL, from the raw tables."""


def _hex(column: str, digits: int) -> str:
    bare = f"ltrim(regexp_replace(regexp_replace(lower(trim({column})), '^\\{{?0x', ''), '[\\s{{}}\\-]', '', 'g'), '0')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{1,{digits}}}') THEN lpad({bare}, {digits}, '0') END"


_BARE = "regexp_replace(regexp_replace(lower(trim(id)), '^urn:uuid:', ''), '[\\s{}\\-]', '', 'g')"
_MESSAGES = f"""
  SELECT *, concat_ws('-', b[1:8], b[9:12], b[13:16], b[17:20], b[21:32]) AS msg_id,
         CAST(floor(epoch_us(timestamp) / 1000.0) AS BIGINT) AS ts_ms
  FROM (SELECT *, {_BARE} AS b FROM otel_logs_and_spans)"""

_RECORDS = """
SELECT project_id, id, epoch_us(timestamp) AS ts_us, CAST(coalesce(epoch_us(updated_at), -1) AS BIGINT) AS version_us
FROM (
  SELECT *, row_number() OVER (
      PARTITION BY project_id, timestamp, id ORDER BY updated_at DESC NULLS LAST, coalesce(deleted, false) DESC) AS rn
  FROM (SELECT * REPLACE (coalesce(project_id, 'default') AS project_id) FROM mor_versioned))
WHERE rn = 1 AND NOT coalesce(deleted, false)"""

_TREE = f"""
WITH RECURSIVE nodes AS (
  SELECT tree, node, min(parent) AS parent
  FROM (SELECT {_hex('context___trace_id', 32)} AS tree, {_hex('context___span_id', 16)} AS node,
               {_hex('parent_id', 16)} AS parent FROM otel_logs_and_spans)
  WHERE tree IS NOT NULL AND node IS NOT NULL GROUP BY tree, node),
walk AS (
  SELECT tree, node, node AS root, 0 AS depth, node AS path FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.tree = n.tree AND p.node = n.parent)
  UNION ALL
  SELECT n.tree, n.node, w.root, w.depth + 1, w.path || '/' || n.node
  FROM nodes n JOIN walk w ON n.tree = w.tree AND n.parent = w.node)"""

_FATES = f"""
WITH arrivals AS (
  SELECT msg_id, ts_ms, min(epoch_us(timestamp)) AS event_us, min(epoch_us(observed_timestamp)) AS arrival_us,
         max(duration) AS duration
  FROM ({_MESSAGES}) GROUP BY msg_id, ts_ms),
ends AS (SELECT *, event_us - event_us % 3600000000 AS start_us, event_us - event_us % 3600000000 + 3600000000 AS end_us FROM arrivals),
fates AS (
  SELECT *, strftime(make_timestamp(start_us), '%Y-%m-%d %H') AS period,
    CASE WHEN arrival_us IS NULL THEN 'unknown' WHEN arrival_us > end_us + 86400000000 THEN 'diverted'
         WHEN arrival_us > end_us + 900000000 THEN 'correction' ELSE 'on_time' END AS fate
  FROM ends)"""

_WHOLE_TREE = _TREE + """,
lost AS (SELECT tree, node, parent FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.tree = n.tree AND w.node = n.node)),
up AS (SELECT tree, node AS start, parent AS at FROM lost UNION SELECT u.tree, u.start, l.parent FROM up u JOIN lost l ON l.tree = u.tree AND l.node = u.at)
SELECT tree, node, root, depth, path, '' AS cycle FROM walk
UNION ALL
SELECT tree, node, '', -1, '', CASE WHEN EXISTS (SELECT 1 FROM up u WHERE u.tree = l.tree AND u.start = l.node AND u.at = l.node) THEN 'on' ELSE 'below' END FROM lost l"""

_WATERMARKED = f"""
WITH events AS (
  SELECT msg_id, ts_ms, min(coalesce(project_id, 'default')) AS source, min(epoch_us(timestamp)) AS event_us, min(epoch_us(observed_timestamp)) AS arrival_us
  FROM ({_MESSAGES}) GROUP BY msg_id, ts_ms),
known AS (SELECT * FROM events WHERE event_us IS NOT NULL AND arrival_us IS NOT NULL),
firsts AS (SELECT source, event_us - 900000000 - (event_us - 900000000) % 3600000000 AS bound, min(arrival_us) AS arrival FROM known GROUP BY 1, 2),
silent AS (SELECT source, max(arrival_us) + 21600000000 AS silent_at FROM known GROUP BY 1),
asked AS (SELECT DISTINCT source, event_us - event_us % 3600000000 + 3600000000 AS bound FROM events WHERE event_us IS NOT NULL),
passed AS (
  SELECT a.source, a.bound, coalesce(min(f.arrival), any_value(s.silent_at)) AS passed_at
  FROM asked a LEFT JOIN firsts f ON f.source = a.source AND f.bound >= a.bound LEFT JOIN silent s ON s.source = a.source GROUP BY 1, 2),
closed AS (SELECT bound, max(passed_at) AS closed_at FROM passed GROUP BY bound HAVING count(*) = count(passed_at)),
fates AS (
  SELECT e.msg_id, e.ts_ms, c.closed_at,
    CASE WHEN arrival_us > event_us - event_us % 3600000000 + 3600000000 + 86400000000 THEN 'diverted' WHEN arrival_us > c.closed_at THEN 'correction' END AS fate
  FROM known e LEFT JOIN closed c ON c.bound = event_us - event_us % 3600000000 + 3600000000)
SELECT msg_id AS id, ts_ms, fate, closed_at FROM fates WHERE fate IS NOT NULL"""

LIVE = """
WITH actions AS (
  SELECT *, regexp_extract(replace(replace(path, '%3D', '='), '%3d', '='), '(project_id=[^/]*/date=[^/]*/[^/]+\\.parquet)\\s*$', 1) AS rel
  FROM file_actions),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rel ORDER BY commit_version DESC, action_type = 'remove' DESC, num_records DESC NULLS LAST) AS rn
  FROM actions WHERE rel <> '' AND commit_version IS NOT NULL),
small AS (
  SELECT rel, coalesce(project_id, 'default') AS project_id, date, size_bytes, num_records,
         count(*) OVER (PARTITION BY coalesce(project_id, 'default'), date) AS n,
         coalesce(sum(size_bytes + 4096) OVER (PARTITION BY coalesce(project_id, 'default'), date ORDER BY size_bytes DESC, rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM ranked WHERE rn = 1 AND action_type = 'add' AND size_bytes < 32768)"""

SQL = {
    "p1_found": _RECORDS,
    "p1_incremental": _RECORDS,
    "p3_found": _TREE + """
SELECT tree AS trace_id, node AS span_id, root AS root_span_id, depth FROM walk WHERE depth >= 8
UNION ALL
SELECT tree, node, '', -1 FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.tree = n.tree AND w.node = n.node)""",
    "p3_descendants": _TREE + """
SELECT w.tree, a.node AS ancestor, count(*) AS descendants, max(w.depth - a.depth) AS height
FROM (SELECT tree, depth, unnest(string_split(path, '/')) AS up, node FROM walk) w
JOIN walk a ON a.tree = w.tree AND a.node = w.up
WHERE w.node <> a.node GROUP BY w.tree, a.node""",
    "p3_hierarchy": _WHOLE_TREE,
    "p3_joined": f"SELECT * EXCLUDE path FROM ({_WHOLE_TREE})",
    "p4_watermarked": _WATERMARKED,
    "p4_found": _FATES + " SELECT msg_id AS id, period FROM fates WHERE fate = 'correction'",
    "p4_hourly": _FATES + """
SELECT period, count(*) FILTER (fate = 'on_time') AS published_n,
       CAST(sum(duration) FILTER (fate = 'on_time') AS BIGINT) AS published_sum,
       count(*) FILTER (fate = 'correction') AS corrections,
       count(*) FILTER (fate IN ('on_time', 'correction')) AS final_n,
       CAST(sum(duration) FILTER (fate IN ('on_time', 'correction')) AS BIGINT) AS final_sum,
       count(*) FILTER (fate = 'diverted') AS diverted_n
FROM fates WHERE fate <> 'unknown' GROUP BY period""",
    "p6_found": f"SELECT msg_id AS id, ts_ms FROM ({_MESSAGES}) GROUP BY msg_id, ts_ms HAVING count(*) > 1",
    "p7_found": LIVE + " SELECT rel AS path FROM small WHERE n >= 2",
    "p7_plan": LIVE + """
SELECT project_id, date, count(*) AS files_before, CAST(sum(size_bytes) AS BIGINT) AS bytes,
       CAST(sum(num_records) AS BIGINT) AS known_records, count(*) FILTER (num_records IS NULL) AS files_without_count,
       CAST(max(ahead // 134217728) + 1 AS BIGINT) AS files_after
FROM small WHERE n >= 2 GROUP BY project_id, date""",
}
