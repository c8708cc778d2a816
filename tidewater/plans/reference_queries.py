"""The query surface: every operator as SQL in the dialect or as a DataFrame plan, over whole tables.

Each entry holds the statement the engine runs and the DuckDB statement with the same result; None: the same text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.engine import Engine
from tidewater.functions import sketches
from tidewater.functions.ids import tenant
from tidewater.operators import mor, rollup, small_files
from tidewater.operators.text_index import TextIndex
from tidewater.operators.tiers import TierStore, fingerprint
from tidewater.plans.checks import ranks_within
from tidewater.plans.pipeline_sql import LIVE
from tidewater.schema import GRAINS, change_feed_schema, metrics_rollups, spans_rollups
from tidewater.session import shared_dir, work_dir
from tidewater.sources.store import PartitionStore
from tidewater.sources.tables import table

SPANS = "otel_logs_and_spans"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", SPANS, "otel_metrics")


def engine(spark: SparkSession, d: str, text: str | None = None) -> Engine:
    """The tables that a statement names, or all, as views."""
    e = Engine(spark)
    for name in TABLES:
        if text is None or name in text:
            e.register(name, table(spark, d, name))
    if text is None or "mor_versioned" in text:
        feed = table(spark, d, "mor_versioned").withColumn("project_id", tenant(F.col("project_id")))
        e.register("mor_versioned", feed, change_feed_schema())
    return e


def _bucket(seconds: int, ts: str = "timestamp") -> str:
    return f"CAST(epoch_us({ts}) // {seconds * 1_000_000} * {seconds} AS BIGINT)"


ERR = "status_code = 'ERROR' OR coalesce(attributes___http___response___status_code, 0) >= 500"
_T5 = "extract(epoch from time_bucket('5 minutes', timestamp))::bigint"
_T1H = "extract(epoch from time_bucket('1 hour', timestamp))::bigint"
_RESOLVED = """(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(project_id, 'default'), date, timestamp, id
  ORDER BY updated_at DESC NULLS LAST, coalesce(deleted, false) DESC) AS rn FROM mor_versioned) WHERE rn = 1 AND NOT coalesce(deleted, false))"""

#: Stands where SQL has no equal: the results of sketches are held against exact ones by queries of their own.
NO_SQL = ""
#: name -> (statement of the engine, statement of DuckDB, None if it is the same, or NO_SQL)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    # time buckets and dashboards
    "throughput_bucket": (f"SELECT {_T5} AS t, count(*)::float AS n FROM {SPANS} GROUP BY time_bucket('5 minutes', timestamp)", f"SELECT {_bucket(300)} AS t, count(*)::DOUBLE AS n FROM {SPANS} GROUP BY 1"),
    "throughput_by_dim": (
        f"SELECT {_T1H} AS t, COALESCE(resource___service___name, 'null') AS service, count(*)::float AS n FROM {SPANS} GROUP BY time_bucket('1 hour', timestamp), COALESCE(resource___service___name, 'null')",
        f"SELECT {_bucket(3600)} AS t, COALESCE(resource___service___name, 'null') AS service, count(*)::DOUBLE AS n FROM {SPANS} GROUP BY 1, 2",
    ),
    "throughput_week": (f"SELECT extract(epoch from time_bucket('1 week', timestamp))::bigint AS t, count(*) AS n FROM {SPANS} GROUP BY 1", f"SELECT {_bucket(604800)} AS t, count(*) AS n FROM {SPANS} GROUP BY 1"),
    "error_rate_filter": (
        f"SELECT {_T1H} AS t, ROUND(COUNT(*) FILTER (WHERE {ERR})::float * 100.0 / count(*)::float, 2) AS rate FROM {SPANS} GROUP BY time_bucket('1 hour', timestamp)",
        f"SELECT {_bucket(3600)} AS t, ROUND(COUNT(*) FILTER (WHERE {ERR})::DOUBLE * 100.0 / count(*)::DOUBLE, 2) AS rate FROM {SPANS} GROUP BY 1",
    ),
    "apdex": (
        f"SELECT resource___service___name AS service, ROUND(SUM(CASE WHEN duration <= 500000000 THEN 1.0 WHEN duration <= 2000000000 THEN 0.5 ELSE 0.0 END)::float / GREATEST(1, COUNT(*))::float, 2) AS apdex, ROUND(COUNT(*)::float / GREATEST(1, EXTRACT(EPOCH FROM (MAX(timestamp) - MIN(timestamp))) / 60)::float, 4) AS rate FROM {SPANS} WHERE kind = 'server' AND duration IS NOT NULL AND resource___service___name IS NOT NULL GROUP BY resource___service___name",
        f"SELECT resource___service___name AS service, ROUND(SUM(CASE WHEN duration <= 500000000 THEN 1.0 WHEN duration <= 2000000000 THEN 0.5 ELSE 0.0 END)::DOUBLE / GREATEST(1, COUNT(*))::DOUBLE, 2) AS apdex, ROUND(COUNT(*)::DOUBLE / GREATEST(1.0, (epoch_us(MAX(timestamp)) - epoch_us(MIN(timestamp))) / 6e7)::DOUBLE, 4) AS rate FROM {SPANS} WHERE kind = 'server' AND duration IS NOT NULL AND resource___service___name IS NOT NULL GROUP BY 1",
    ),
    "topk_groups": (f"SELECT name, COUNT(*) AS n FROM {SPANS} WHERE name IS NOT NULL GROUP BY name ORDER BY n DESC, name LIMIT 50", None),
    "facets": (f"SELECT (\"resource___service___name\")::text AS value, COUNT(*)::bigint AS n FROM public.{SPANS} WHERE (\"resource___service___name\") IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", f"SELECT resource___service___name AS value, COUNT(*) AS n FROM {SPANS} WHERE resource___service___name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "distinct_picker": (f"SELECT DISTINCT resource___service___name AS service FROM {SPANS} WHERE resource___service___name IS NOT NULL", None),
    "cross_project_picker": (f"SELECT DISTINCT project_id FROM {SPANS} WHERE kind IN ('server', 'client', 'producer', 'consumer')", None),
    "pctl_bucket": (f"SELECT {_T1H} AS t, ROUND(COALESCE(approx_percentile(0.95, percentile_agg(CAST(duration AS DOUBLE PRECISION))), 0)::float / 1000000, 4) AS p95 FROM {SPANS} WHERE duration IS NOT NULL GROUP BY time_bucket('1 hour', timestamp)", NO_SQL),
    "pctl_array_unnest": (
        f"SELECT s.service, u.p FROM (SELECT resource___service___name AS service, ARRAY[approx_percentile(0.5, percentile_agg(duration)), approx_percentile(0.9, percentile_agg(duration))] AS ps FROM {SPANS} WHERE duration IS NOT NULL GROUP BY 1) AS s CROSS JOIN LATERAL unnest(s.ps) AS u(p)",
        NO_SQL,
    ),
    "percentile_cont": ("SELECT event_type, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS q FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q FROM events GROUP BY event_type"),
    "log_list_topk": (f"SELECT id, extract(epoch from timestamp) AS t, name FROM {SPANS} ORDER BY timestamp DESC, id LIMIT 251", f"SELECT id, epoch_us(timestamp) / 1e6 AS t, name FROM {SPANS} ORDER BY timestamp DESC, id, name DESC LIMIT 251"),
    "cursor_page": (f"SELECT id FROM {SPANS} WHERE timestamp <= '2023-01-08T00:00:00Z' ORDER BY timestamp DESC, id LIMIT 100", f"SELECT id FROM {SPANS} WHERE timestamp <= TIMESTAMPTZ '2023-01-08 00:00:00+00' ORDER BY timestamp DESC, id LIMIT 100"),
    "offset_page": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40", None),
    "point_lookup": (f"SELECT id, name, duration FROM {SPANS} WHERE context___trace_id = (SELECT min(context___trace_id) FROM {SPANS} WHERE length(context___trace_id) = 32 AND context___trace_id > '1')", None),
    "date_prune": (f"SELECT count(*) AS n, sum(duration)::bigint AS s FROM {SPANS} WHERE timestamp >= '2023-01-03T06:00:00Z' AND timestamp < '2023-01-05T18:00:00Z'", f"SELECT count(*) AS n, sum(duration)::BIGINT AS s FROM {SPANS} WHERE timestamp >= TIMESTAMPTZ '2023-01-03 06:00:00+00' AND timestamp < TIMESTAMPTZ '2023-01-05 18:00:00+00'"),
    "date_prune_between": (f"SELECT date, count(*) AS n FROM {SPANS} WHERE timestamp BETWEEN '2023-01-03T06:00:00Z' AND '2023-01-04T06:00:00Z' GROUP BY date", f"SELECT date, count(*) AS n FROM {SPANS} WHERE timestamp BETWEEN TIMESTAMPTZ '2023-01-03 06:00:00+00' AND TIMESTAMPTZ '2023-01-04 06:00:00+00' GROUP BY date"),
    "count_all": (f"SELECT count(*) AS n FROM {SPANS}", None),
    "pct_of_total": (f"SELECT kind, COUNT(*) AS n, ROUND(COUNT(*) * 100.0::float / SUM(COUNT(*)) OVER (), 4) AS pct FROM {SPANS} GROUP BY kind", f"SELECT kind, COUNT(*) AS n, ROUND(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (), 4) AS pct FROM {SPANS} GROUP BY kind"),
    "total_rows_companion": ("SELECT event_type, count(*) AS n, count(*) OVER () AS groups FROM events GROUP BY event_type", None),
    # distinct counts
    "dcount_exact": (f"SELECT kind, COUNT(DISTINCT context___trace_id) AS n FROM {SPANS} GROUP BY kind", None),
    "dcount_sketch": (f"SELECT date, distinct_count(approx_count_distinct(context___trace_id)) AS traces, distinct_count(hll_agg(id)) AS ids FROM {SPANS} GROUP BY date", NO_SQL),
    "dcount_merge": ("SELECT hll_count(hll_merge(s)) AS types, hll_count(hll_merge(u)) AS flags FROM (SELECT event_type, hll_agg(event_type) AS s, hll_agg(value > 50) AS u FROM events GROUP BY event_type) AS x", "SELECT count(DISTINCT event_type) AS types, count(DISTINCT value > 50) AS flags FROM events"),
    # aggregates, grouping, HAVING
    "aggregates": ("SELECT l_returnflag, count(*) AS n, count(l_tax) AS c, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate)::text AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, count(l_tax) AS c, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate)::VARCHAR AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1"),
    "median_stddev": ("SELECT event_type, round(median(value), 6) AS m, round(stddev(value), 6) AS s FROM events GROUP BY event_type", None),
    "having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", None),
    "group_by_ordinal": (f"SELECT kind, level, count(*)::float AS n FROM {SPANS} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2", f"SELECT kind, level, count(*)::DOUBLE AS n FROM {SPANS} GROUP BY 1, 2"),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "rollup_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "filter_clause": ("SELECT count(*) FILTER (WHERE value > 50) AS a, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS b, count(*) FILTER (WHERE event_type = 'none') AS z FROM events", None),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    # predicates and expressions
    "predicates": (f"SELECT count(*) AS n FROM {SPANS} WHERE duration BETWEEN 1000 AND 5000000 AND kind IN ('server', 'client') AND level NOT IN ('DEBUG') AND name IS NOT NULL AND NOT (status_code = 'OK')", None),
    "like_ilike": ("SELECT doc_id FROM documents WHERE text LIKE '%rollup%' OR text ILIKE '%QUEUE DEPTH%' AND text NOT LIKE '%★%'", None),
    "regex_match": (f"SELECT name, name ~ '^GET' AS a, name ~* '^get /v[12]' AS b, name !~ 'x' AS c, name !~* 'PUBLISH$' AS d FROM {SPANS} WHERE name IS NOT NULL GROUP BY name", f"SELECT name, regexp_matches(name, '^GET') AS a, regexp_matches(name, '^get /v[12]', 'i') AS b, NOT regexp_matches(name, 'x') AS c, NOT regexp_matches(name, 'PUBLISH$', 'i') AS d FROM {SPANS} WHERE name IS NOT NULL GROUP BY name"),
    "array_contains_all": (f"SELECT id, hashes @> ARRAY['h8b66'] AS a, summary @> ARRAY[]::text[] AS b FROM {SPANS} WHERE hashes IS NOT NULL", f"SELECT id, list_has_all(hashes, ['h8b66']) AS a, true AS b FROM {SPANS} WHERE hashes IS NOT NULL"),
    "array_overlap": (f"SELECT count(*) AS n FROM {SPANS} WHERE summary && ARRAY['svc:beacon-gateway', 'svc:quill-store']", f"SELECT count(*) AS n FROM {SPANS} WHERE list_has_any(summary, ['svc:beacon-gateway', 'svc:quill-store'])"),
    "any_array": (f"SELECT count(*) AS n FROM {SPANS} WHERE 'svc:beacon-gateway' = ANY(summary)", f"SELECT count(*) AS n FROM {SPANS} WHERE list_contains(summary, 'svc:beacon-gateway')"),
    "array_literal": (f"SELECT id, array_length(coalesce(hashes, '{{}}'), 1) AS n FROM {SPANS}", f"SELECT id, CAST(len(coalesce(hashes, [])) AS INTEGER) AS n FROM {SPANS}"),
    "array_access": (f"SELECT id, summary[1] AS first, array_element(summary, 2) AS second, summary[9] AS none, make_array('a', 'b')[2] AS b FROM {SPANS}", f"SELECT id, summary[1] AS first, summary[2] AS second, summary[9] AS none, 'b' AS b FROM {SPANS}"),
    "case_coalesce_nullif": (f"SELECT coalesce(level, kind, 'none') AS a, CASE WHEN duration > 1000000 THEN 'slow' WHEN duration IS NULL THEN 'log' ELSE 'fast' END AS b, nullif(status_code, 'UNSET') AS c, count(*) AS n FROM {SPANS} GROUP BY 1, 2, 3", None),
    "integer_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, (o_orderkey + 1) / 2 AS h, o_totalprice / 2 AS f FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, (o_orderkey + 1) // 2 AS h, o_totalprice / 2 AS f FROM orders"),
    "string_functions": ("SELECT c_custkey, LEFT(c_name, 4) || '-' || c_mktsegment AS a, LENGTH(c_name) AS n, substr(c_name, 3, 2) AS s, md5(c_name) AS m, REPEAT('ab', 2) AS r, concat_ws('/', c_name, c_mktsegment) AS w, chr(65) AS ch FROM customer", None),
    "exists_in_select": ("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS small FROM customer", None),
    "derived_aliases": ("SELECT t.a, t.b FROM (SELECT n_name, n_regionkey FROM nation) AS t(a, b) WHERE t.b = 2", None),
    "null_order": (f"SELECT level FROM (SELECT DISTINCT level FROM {SPANS}) AS x ORDER BY level DESC LIMIT 2", f"SELECT level FROM (SELECT DISTINCT level FROM {SPANS}) AS x ORDER BY level DESC NULLS FIRST LIMIT 2"),
    "hash_bucket_range": (f"SELECT hash_bucket(name, 16) AS b, count(*) AS n FROM {SPANS} GROUP BY 1", f"SELECT CAST('0x' || left(md5(coalesce(name, '')), 15) AS BIGINT) % 16 AS b, count(*) AS n FROM {SPANS} GROUP BY 1"),
    "text_match": ("SELECT doc_id FROM documents WHERE text_match(text, 'write BUFFER*')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'write') AND contains(lower(text), 'buffer')"),
    # time functions
    "to_char_fmt": (f"SELECT id, to_char(timestamp, 'YYYY-MM-DD HH24:MI:SS.MS') AS a, to_char(timestamp, 'Mon DD, YY HH12:MI') AS b, to_char(timestamp, 'Day \"day\" Dy Month') AS c FROM {SPANS}", f"SELECT id, strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%g') AS a, strftime(timestamp AT TIME ZONE 'UTC', '%b %d, %y %I:%M') AS b, strftime(timestamp AT TIME ZONE 'UTC', '%A day %a %B') AS c FROM {SPANS}"),
    "at_time_zone": (f"SELECT id, to_char(at_time_zone(timestamp, 'Asia/Tokyo'), 'YYYY-MM-DD HH24:MI') AS t FROM {SPANS}", f"SELECT id, strftime(timestamp AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M') AS t FROM {SPANS}"),
    "extract_parts": (f"SELECT id, EXTRACT(YEAR FROM timestamp)::int AS y, EXTRACT(MONTH FROM timestamp)::int AS m, EXTRACT(DOW FROM timestamp)::int AS w, EXTRACT(SECOND FROM timestamp) AS s, extract(epoch from timestamp) AS e, date_part('hour', timestamp)::int AS h FROM {SPANS}", f"SELECT id, year(t)::INT AS y, month(t)::INT AS m, dayofweek(t)::INT AS w, second(t)::INT AS s, epoch_us(t) / 1e6 AS e, hour(t)::INT AS h FROM (SELECT id, timestamp AT TIME ZONE 'UTC' AS t FROM {SPANS})"),
    "date_trunc_group": (f"SELECT to_char(date_trunc('day', timestamp), 'YYYY-MM-DD') AS d, count(*) AS n FROM {SPANS} GROUP BY 1", f"SELECT strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m-%d') AS d, count(*) AS n FROM {SPANS} GROUP BY 1"),
    "interval_arithmetic": (f"SELECT count(*) AS n FROM {SPANS} WHERE observed_timestamp > timestamp + INTERVAL '15 minutes' AND observed_timestamp <= timestamp + INTERVAL '1 day 2 hours'", None),
    # JSON and Variant
    "json_arrow": (f"SELECT id, resource->'service'->>'name' AS s, attributes->>'shard' AS shard, events->0->>'name' AS e FROM {SPANS}", f"SELECT id, CASE WHEN json_valid(resource) THEN resource->'service'->>'name' END AS s, CASE WHEN json_valid(attributes) THEN attributes->>'shard' END AS shard, CASE WHEN json_valid(events) THEN events->0->>'name' END AS e FROM {SPANS}"),
    "variant_get": ("SELECT event_id, json_to_variant(props)->>'k' AS k, variant_to_json(variant_get(json_to_variant(props), 'none')) AS missing, is_variant_null(variant_get(json_to_variant(props), 'none')) AS nul FROM events", "SELECT event_id, props->>'k' AS k, 'null' AS missing, true AS nul FROM events"),
    "variant_compare": ("SELECT count(*) AS n FROM events WHERE json_to_variant(props)->'k' = '7'", "SELECT count(*) AS n FROM events WHERE CAST(props->>'k' AS INT) = 7"),
    "jsonb_path_exists": ("SELECT event_id, jsonb_path_exists(props, '$.k ? (@ > 50)') AS a, jsonb_path_exists(props, '$.none') AS b FROM events", "SELECT event_id, CAST(props->>'k' AS INT) > 50 AS a, false AS b FROM events"),
    "json_build_array": ("SELECT event_id, jsonb_build_array(event_type, user_id, value > 50, NULL) AS j FROM events", "SELECT event_id, '[' || '\"' || event_type || '\",' || user_id || ',' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END || ',null]' AS j FROM events"),
    "row_to_json": ("SELECT row_to_json(t) AS j FROM (SELECT n_nationkey AS k, n_name AS n FROM nation) AS t", "SELECT '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' AS j FROM nation"),
    "json_length": (f"SELECT id, json_length(events) AS n, json_contains(attributes, 'shard') AS c FROM {SPANS} WHERE events LIKE '[%]' AND attributes LIKE '{{%}}'", f"SELECT id, CAST(CASE WHEN json_valid(events) THEN json_array_length(events) END AS BIGINT) AS n, coalesce(CASE WHEN json_valid(attributes) THEN json_exists(attributes, '$.shard') END, false) AS c FROM {SPANS} WHERE events LIKE '[%]' AND attributes LIKE '{{%}}'"),
    # joins
    "join_inner": ("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "join_left": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", None),
    "join_right": ("SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", None),
    "join_full": ("SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500) AS a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) AS b ON a.k = b.k", None),
    "join_semi": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "join_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_using_topn": (f"WITH top AS (SELECT name, count(*) AS total FROM {SPANS} WHERE name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT name, total, count(*) FILTER (WHERE {ERR}) AS errors FROM {SPANS} JOIN top USING (name) GROUP BY name, total", None),
    "self_join_edges": (
        f"WITH s AS (SELECT context___trace_id AS tid, context___span_id AS sid, parent_id AS par, resource___service___name AS svc, kind AS knd FROM {SPANS} WHERE context___trace_id <> '' AND kind IN ('server', 'client', 'internal', 'producer', 'consumer')) SELECT p.svc AS source, c.svc AS target, count(*) AS n FROM s AS c JOIN s AS p ON c.tid = p.tid AND c.par = p.sid WHERE p.svc <> c.svc GROUP BY 1, 2",
        None,
    ),
    "cross_join_values": ("SELECT r_name, q.q FROM region CROSS JOIN (VALUES (0.5, 'a'), (0.9, 'b')) AS q(v, q)", "SELECT r_name, q.q FROM region CROSS JOIN (VALUES (0.5, 'a'), (0.9, 'b')) AS q(v, q)"),
    "digest_values": (
        "WITH d AS (SELECT n_regionkey AS r, percentile_agg(n_nationkey) AS g FROM nation GROUP BY 1 HAVING COUNT(*) > 0) SELECT d.r, q.name, round(approx_percentile(q.p, d.g), 6) AS v FROM d CROSS JOIN (VALUES (0.5, 'p50'), (0.9, 'p90'), (1.0, 'max')) AS q(p, name)",
        "SELECT n_regionkey AS r, q.name, round(quantile_cont(n_nationkey, 0.5), 6) AS v FROM nation CROSS JOIN (VALUES ('p50')) AS q(name) GROUP BY 1, 2 UNION ALL SELECT n_regionkey, 'p90', round(quantile_cont(n_nationkey, 0.9), 6) FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 'max', max(n_nationkey)::DOUBLE FROM nation GROUP BY 1",
    ),
    "correlated_scalar": ("SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region", None),
    "values_source": ("SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)", None),
    "unnest_source": (f"SELECT u.tag, count(*) AS n FROM {SPANS} CROSS JOIN LATERAL unnest(summary) AS u(tag) GROUP BY u.tag", f"SELECT tag, count(*) AS n FROM (SELECT unnest(summary) AS tag FROM {SPANS}) GROUP BY tag"),
    # windows
    "moving_avg": ("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a FROM events", None),
    "ranks": ("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "lag_lead": ("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM orders", None),
    "range_frame": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM events", None),
    # sets, CTEs, DISTINCT ON
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900", None),
    "recursive_cte": ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 10) SELECT sum(n) AS s FROM r", "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 10) SELECT CAST(sum(n) AS BIGINT) AS s FROM r"),
    "distinct_on_first": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", None),
    # merge on read
    "mor_resolve": ("SELECT project_id, id, name, extract(epoch from updated_at) AS v FROM mor_versioned", f"SELECT coalesce(project_id, 'default') AS project_id, id, name, epoch_us(updated_at) / 1e6 AS v FROM {_RESOLVED}"),
    "mor_filter_after": ("SELECT count(*) AS n FROM mor_versioned WHERE name IS NULL", f"SELECT count(*) AS n FROM {_RESOLVED} WHERE name IS NULL"),
    "mor_versions_per_key": ("SELECT n, count(*) AS keys FROM (SELECT project_id, timestamp, id, count(*) AS n FROM mor_versioned__all GROUP BY 1, 2, 3) AS x GROUP BY n", "SELECT n, count(*) AS keys FROM (SELECT coalesce(project_id, 'default') AS project_id, timestamp, id, count(*) AS n FROM mor_versioned GROUP BY 1, 2, 3) AS x GROUP BY n"),
    # metrics
    "metric_series": ("SELECT metric_name, metric_type, count(*) AS n, count(value) AS v, max(value_int) AS hi FROM otel_metrics GROUP BY 1, 2", None),
}


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d, text).sql(text)


# --- plans that are no single statement


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SPANS).withColumn("project_id", tenant(F.col("project_id")))


def _count_by_hour(df: DataFrame) -> DataFrame:
    return df.select((F.col("time") / 1_000_000).cast("long").alias("t"), "service", "n", "errors", "s", "a")


ASKS = (rollup.Ask("n", "count"), rollup.Ask("errors", "count", None, spans_rollups()[0].measures[1].filter), rollup.Ask("s", "sum", "duration"), rollup.Ask("a", "avg", "duration"))


def _hourly(**more) -> rollup.AggregateQuery:
    return rollup.AggregateQuery(ASKS, bucket=3600, group=("resource___service___name",), all_projects=True, **more)


_DAY = 86_400_000_000
_FIRST = 1_672_617_600_000_000  # 2023-01-02


#: Tiers that are open, as an engine keeps them: session and source -> fingerprint of the source, store, tiers.
_OPEN: dict[tuple[str, int, str], tuple[str, TierStore, list[rollup.Tier]]] = {}


def _stored(spark: SparkSession, d: str) -> tuple[TierStore, list[rollup.Tier]]:
    """The tiers of the span table below the shared folder: built by the first query that asks, found there by the others."""
    source = f"{d}/{SPANS}.parquet"
    mark, key = fingerprint(spark, source), (spark.sparkContext.applicationId, id(spark), source)
    if key not in _OPEN or _OPEN[key][0] != mark:
        raw = _spans(spark, d)
        store = TierStore(spark, f"{shared_dir(spark)}/tidewater-tiers-{hashlib.md5(source.encode()).hexdigest()}", spans_rollups(), raw.schema)
        if store.source() != mark:
            store.build(raw, mark)
        _OPEN[key] = mark, store, store.tiers()
    return _OPEN[key][1:]


def _routed(spark: SparkSession, d: str, start: int, end: int, ranges: list[tuple[int, int]]) -> DataFrame:
    tiers = [rollup.Tier(t.spec, t.data, rollup.Coverage(ranges)) for t in _stored(spark, d)[1]]
    df, _ = rollup.answer(_hourly(start=start, end=end), _spans(spark, d), tiers)
    return df.select((F.col("time") / 1_000_000).cast("long").alias("t"), F.col("resource___service___name").alias("service"), "n", "errors", "s", F.round("a", 3).alias("a"))


def rollup_store(spark: SparkSession, d: str) -> DataFrame:
    """The stored tiers: per tier and date their rows and what they count."""
    _, tiers = _stored(spark, d)
    legs = [t.data.groupBy(F.lit(t.spec.name).alias("tier"), "date").agg(F.count("*").alias("states"), F.sum("request_count").alias("n"), F.sum("duration_sum").alias("s")) for t in tiers]
    return legs[0].unionByName(legs[1])


_DASHBOARD = f"""SELECT project_id, {_T1H} AS t, COALESCE(resource___service___name, 'none') AS service, count(*)::float AS n, ROUND(COUNT(*) FILTER (WHERE {ERR})::float * 100.0 / count(*)::float, 2) AS rate, max(duration) AS slowest
FROM {SPANS} WHERE timestamp >= '2023-01-02T06:30:00Z' AND timestamp < '2023-01-09T00:10:00Z' AND kind = 'server' GROUP BY 1, 2, 3 HAVING count(*) > 1"""


def rollup_sql(spark: SparkSession, d: str) -> DataFrame:
    """A dashboard's plain SELECT: whole hours from the stored tier, the ragged ends from raw rows."""
    e = Engine(spark)
    e.register(SPANS, _spans(spark, d))
    e.stored_tiers[SPANS], e.tiers[SPANS] = _stored(spark, d)
    df = e.sql(_DASHBOARD)
    if e.stats["rollup_hybrid"] != 1:
        raise RuntimeError(f"not answered from the tier: {dict(e.stats)} {e.last_miss}")
    return df


def rollup_routed(spark: SparkSession, d: str) -> DataFrame:
    """Whole hours, all of them in the coarse tier."""
    return _routed(spark, d, _FIRST, _FIRST + 10 * _DAY, [(_FIRST - _DAY, _FIRST + 11 * _DAY)])


def rollup_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """A ragged window, of which the tier covers a middle part; the rest comes from raw rows."""
    return _routed(spark, d, _FIRST + 1_234_567, _FIRST + 5 * _DAY + 98_765_432, [(_FIRST + _DAY, _FIRST + 3 * _DAY), (_FIRST + 3 * _DAY + 7_200_000_000, _FIRST + 4 * _DAY)])


def rollup_1m(spark: SparkSession, d: str) -> DataFrame:
    fine = spans_rollups()[0]
    return rollup.build(_spans(spark, d), fine).select((F.col("bucket") / 1_000_000).cast("long").alias("t"), "project_id", *fine.dimensions, "request_count", "error_count", "duration_sum", "duration_min", "duration_max")


def rollup_1h_from_1m(spark: SparkSession, d: str) -> DataFrame:
    fine, coarse = spans_rollups()
    return rollup.derive(rollup.build(_spans(spark, d), fine), coarse).select((F.col("bucket") / 1_000_000).cast("long").alias("t"), "project_id", *fine.dimensions, "request_count", "error_count", "duration_sum", "duration_min", "duration_max")


def rollup_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A stale tier (every third hour lost its rows) refreshed for exactly those hours."""
    fine = spans_rollups()[0]
    raw = _spans(spark, d)
    hour = lambda x: x - F.pmod(x, F.lit(3_600_000_000))
    stale = F.pmod(F.unix_micros("timestamp") / 3_600_000_000, F.lit(3)).cast("int") == 0
    dirty = raw.where(stale).select("project_id", hour(F.unix_micros("timestamp")).alias("hour")).distinct()
    tier = rollup.build(raw.where(~stale | (F.col("kind") == "server")), fine)
    return rollup.refresh(tier, raw, fine, dirty).select((F.col("bucket") / 1_000_000).cast("long").alias("t"), "project_id", *fine.dimensions, "request_count", "error_count", "duration_sum", "duration_min", "duration_max")


def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    spec = metrics_rollups()[1]
    points = table(spark, d, "otel_metrics").withColumn("project_id", tenant(F.col("project_id")))
    return rollup.derive(rollup.build(points, metrics_rollups()[0]), spec).select((F.col("bucket") / 1_000_000).cast("long").alias("t"), "project_id", *spec.dimensions, "point_count", "value_count")


def flush_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per (timestamp, id) of the span table: the greatest version, ties to the greatest name."""
    rows = table(spark, d, SPANS).select("timestamp", "id", "updated_at", "name")
    return mor.flush_dedup(rows, ["timestamp", "id"], "updated_at", "name").select("id", F.unix_micros("timestamp").alias("t"), F.unix_micros("updated_at").alias("v"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first over a key without versions."""
    return table(spark, d, SPANS).select("timestamp", "id").dropDuplicates(["timestamp", "id"]).groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))


POINTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
_ASKED = ", ".join(f"approx_percentile({q}, {{0}}) AS {name}" for name, q in POINTS.items())


def _durations(spark: SparkSession, d: str, key: str, alias: str) -> DataFrame:
    return table(spark, d, SPANS).select(F.expr(key).alias(alias), F.col("duration").cast("double").alias("duration"))


def pctl_hour_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every hour by percentile_agg, held against all durations: count, and whether each rank is within the error of the sketch."""
    got = engine(spark, d, SPANS).sql(f"SELECT {_T1H} AS t, {_ASKED.format('percentile_agg(duration)')} FROM {SPANS} WHERE duration IS NOT NULL GROUP BY time_bucket('1 hour', timestamp)")
    return ranks_within(got, _durations(spark, d, "CAST(unix_micros(timestamp) DIV 3600000000 * 3600 AS BIGINT)", "t"), ["t"], "duration", POINTS, 3 * sketches.RANK_ERROR)


def pctl_merge_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per service from digests of its days by tdigest_merge, held against all durations."""
    days = f"SELECT resource___service___name AS service, date, percentile_agg(duration) AS s FROM {SPANS} WHERE duration IS NOT NULL GROUP BY 1, 2"
    got = engine(spark, d, SPANS).sql(f"SELECT service, {_ASKED.format('tdigest_merge(s)')} FROM ({days}) AS d GROUP BY service")
    return ranks_within(got, _durations(spark, d, "resource___service___name", "service"), ["service"], "duration", POINTS, 3 * sketches.RANK_ERROR)


def pctl_rollup_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per service from the digests of the stored hourly tier, held against all durations."""
    q = rollup.AggregateQuery(tuple(rollup.Ask(name, "percentile", "duration", p=p) for name, p in POINTS.items()), start=_FIRST - 300 * _DAY, end=_FIRST + 300 * _DAY, by_project=True, group=("resource___service___name",))
    tier = _stored(spark, d)[1][1]
    one = rollup.answer(q, _spans(spark, d), [tier])[0].select("project_id", F.col("resource___service___name").alias("service"), *POINTS)
    rows = _spans(spark, d).select("project_id", F.col("resource___service___name").alias("service"), F.col("duration").cast("double").alias("duration"))
    return ranks_within(one, rows, ["project_id", "service"], "duration", POINTS, 3 * sketches.RANK_ERROR)


def dcount_error(spark: SparkSession, d: str) -> DataFrame:
    """Distinct trace ids and message ids of every day by hll_agg, and of all days by hll_merge, against exact counts: these, and whether the sketch is within 4 standard errors."""
    e = engine(spark, d, SPANS)
    days = e.sql(f"SELECT date, hll_agg(context___trace_id) AS t, hll_agg(id) AS i FROM {SPANS} GROUP BY date")
    days.createOrReplaceTempView("dcount_days")
    got = e.sql("SELECT date, hll_count(t) AS t, hll_count(i) AS i FROM dcount_days UNION ALL SELECT NULL, hll_count(hll_merge(t)), hll_count(hll_merge(i)) FROM dcount_days")
    exact = table(spark, d, SPANS).groupingSets([[F.col("date")], []], "date").agg(F.count_distinct("context___trace_id").alias("traces"), F.count_distinct("id").alias("ids"))
    off = lambda a, b: (F.abs(F.col(a) / F.col(b) - 1) <= 4 * sketches.HLL_ERROR).alias(f"{b}_within")
    return exact.join(got.withColumnRenamed("date", "day"), F.col("date").eqNullSafe(F.col("day"))).select("date", "traces", "ids", off("t", "traces"), off("i", "ids"))


def mor_update_from(spark: SparkSession, d: str) -> DataFrame:
    """The change feed as a stored table, after an UPDATE ... FROM, an UPDATE and a DELETE of one project."""
    e = engine(spark, d, "mor_versioned")
    schema = change_feed_schema()
    kept = e.create("mor_stored", work_dir(spark, "stored"), schema)
    kept.store.replace(mor.normalize(table(spark, d, "mor_versioned"), schema).hint("rebalance", F.col("project_id"), F.col("date")))
    e._show("mor_stored")
    e.execute("UPDATE mor_stored AS m SET name = s.v FROM (SELECT id AS k, count(*) AS n, max(name) || ' and t.name' AS v FROM mor_versioned__all GROUP BY id) AS s WHERE m.id = s.k AND (m.name <> 'x and y' OR m.name IS NULL) AND s.n BETWEEN 2 AND 5 AND project_id = 'default'")
    e.execute("DELETE FROM mor_stored WHERE project_id = $1 AND name LIKE $2", "default", "%e and t.name")
    return e.sql("SELECT project_id, id, name, extract(epoch from timestamp) AS t FROM mor_stored")


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """text_match over documents stored with a text index: only files that can hold every word are opened."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"))
    store = PartitionStore(spark, work_dir(spark, "documents"), docs.schema, ["source"])
    store.replace(docs.hint("rebalance", F.col("source")))
    index = TextIndex(store, ["text"])
    index.update()
    return index.match("text", "write BUFFER*").select("doc_id")


def count_from_log(spark: SparkSession, d: str) -> DataFrame:
    return small_files.counts_from_log(table(spark, d, "file_actions"))


def retried_bins(spark: SparkSession, d: str) -> DataFrame:
    """Ten-minute bins of the span table with repeated keys: what a dedup rewrite has to touch."""
    t = F.unix_micros("timestamp")
    many = table(spark, d, SPANS).groupBy("timestamp", "id").count().where("count > 1")
    return many.groupBy((t - F.pmod(t, F.lit(600_000_000))).alias("bin")).agg(F.count("*").alias("keys"), F.sum(F.col("count") - 1).alias("surplus"))


PLANS = {f.__name__: f for f in (pctl_hour_rank, pctl_merge_rank, pctl_rollup_rank, dcount_error, mor_update_from, text_search, rollup_store, rollup_sql, count_from_log, retried_bins, rollup_1m, rollup_1h_from_1m, rollup_refresh, rollup_routed, rollup_hybrid, metrics_rollup, flush_dedup, exact_duplicates)}


def _tier_sql(grain: str, raw: str = SPANS) -> str:
    s = GRAINS[grain]
    return f"""SELECT {_bucket(s)} AS t, coalesce(project_id, 'default') AS project_id, resource___service___name, kind, status_code,
  count(*) AS request_count, count(*) FILTER ({ERR}) AS error_count, CAST(sum(duration) AS BIGINT) AS duration_sum, min(duration) AS duration_min,
  max(duration) AS duration_max FROM {raw} GROUP BY ALL"""


def _store_sql() -> str:
    return " UNION ALL ".join(_TIER_ROWS.format(tier=f"dashboard_{g}", rows=_tier_sql(g)) for g in ("1m", "1h"))


def _hourly_sql(start: int, end: int) -> str:
    return f"""SELECT {_bucket(3600)} AS t, resource___service___name AS service, count(*) AS n, count(*) FILTER ({ERR}) AS errors, CAST(sum(duration) AS BIGINT) AS s,
  round(avg(duration), 3) AS a FROM {SPANS} WHERE epoch_us(timestamp) >= {start} AND epoch_us(timestamp) < {end} GROUP BY 1, 2"""


_TIER_ROWS = "SELECT '{tier}' AS tier, date, count(*) AS states, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s FROM (SELECT CAST(make_timestamp(t * 1000000) AS DATE) AS date, request_count AS n, duration_sum AS s FROM ({rows})) GROUP BY date"
_WITHIN = ", ".join(f"true AS {name}_within" for name in POINTS)
_FEED = "(SELECT * REPLACE (coalesce(project_id, 'default') AS project_id) FROM mor_versioned)"

PLAN_SQL = {
    "pctl_hour_rank": f"SELECT {_bucket(3600)} AS t, count(*) AS n, {_WITHIN} FROM {SPANS} WHERE duration IS NOT NULL GROUP BY 1",
    "pctl_merge_rank": f"SELECT resource___service___name AS service, count(*) AS n, {_WITHIN} FROM {SPANS} WHERE duration IS NOT NULL GROUP BY 1",
    "pctl_rollup_rank": f"SELECT coalesce(project_id, 'default') AS project_id, resource___service___name AS service, count(*) AS n, {_WITHIN} FROM {SPANS} WHERE duration IS NOT NULL GROUP BY 1, 2",
    "dcount_error": f"SELECT date, count(DISTINCT context___trace_id) AS traces, count(DISTINCT id) AS ids, true AS traces_within, true AS ids_within FROM {SPANS} GROUP BY GROUPING SETS ((date), ())",
    "mor_update_from": f"""WITH feed AS {_FEED}, current AS {_RESOLVED.replace("FROM mor_versioned", "FROM feed")},
s AS (SELECT id AS k, count(*) AS n, max(name) || ' and t.name' AS v FROM feed GROUP BY id),
updated AS (SELECT c.project_id, c.id, c.timestamp, CASE WHEN c.project_id = 'default' AND s.n BETWEEN 2 AND 5 AND (c.name <> 'x and y' OR c.name IS NULL) THEN s.v ELSE c.name END AS name FROM current c JOIN s ON s.k = c.id)
SELECT project_id, id, name, epoch_us(timestamp) / 1e6 AS t FROM updated WHERE NOT (project_id = 'default' AND coalesce(name LIKE '%e and t.name', false))""",
    "count_from_log": LIVE + """ SELECT coalesce(project_id, 'default') AS project_id, date, CASE WHEN count(*) = count(num_records) THEN CAST(sum(num_records) AS BIGINT) END AS n, count(*) AS files
FROM ranked WHERE rn = 1 AND action_type = 'add' GROUP BY ALL""",
    "retried_bins": f"SELECT bin, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT epoch_us(timestamp) - epoch_us(timestamp) % 600000000 AS bin, count(*) AS n FROM {SPANS} GROUP BY timestamp, id HAVING count(*) > 1) GROUP BY bin",
    "rollup_1m": _tier_sql("1m"), "rollup_1h_from_1m": _tier_sql("1h"), "rollup_refresh": _tier_sql("1m"),
    "text_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'write') AND contains(lower(text), 'buffer')",
    "rollup_store": _store_sql(),
    "rollup_sql": f"""SELECT coalesce(project_id, 'default') AS project_id, {_bucket(3600)} AS t, coalesce(resource___service___name, 'none') AS service, count(*)::DOUBLE AS n,
  ROUND(count(*) FILTER ({ERR})::DOUBLE * 100.0 / count(*)::DOUBLE, 2) AS rate, max(duration) AS slowest FROM {SPANS}
  WHERE timestamp >= TIMESTAMPTZ '2023-01-02 06:30:00+00' AND timestamp < TIMESTAMPTZ '2023-01-09 00:10:00+00' AND kind = 'server' GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "rollup_routed": _hourly_sql(_FIRST, _FIRST + 10 * _DAY), "rollup_hybrid": _hourly_sql(_FIRST + 1_234_567, _FIRST + 5 * _DAY + 98_765_432),
    "metrics_rollup": f"SELECT {_bucket(3600)} AS t, coalesce(project_id, 'default') AS project_id, metric_name, resource___service___name, count(*) AS point_count, count(value) AS value_count FROM otel_metrics GROUP BY ALL",
    "flush_dedup": f"SELECT id, epoch_us(timestamp) AS t, max(epoch_us(updated_at)) AS v FROM {SPANS} GROUP BY id, timestamp",
    "exact_duplicates": f"SELECT CAST(timestamp AT TIME ZONE 'UTC' AS DATE) AS day, count(DISTINCT (timestamp, id)) AS n FROM {SPANS} GROUP BY 1",
}

QUERIES = {**{name: _statement(text) for name, (text, _) in STATEMENTS.items()}, **PLANS}
SQL = {**{name: text if other is None else other for name, (text, other) in STATEMENTS.items() if other != NO_SQL}, **PLAN_SQL}
