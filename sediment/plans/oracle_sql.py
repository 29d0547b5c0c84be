"""ANSI SQL with the meaning of each registered query, over the same tables."""

from __future__ import annotations

# The derived inputs as common table expressions; see ``inputs``.
CANONICAL = """
ce AS (
  SELECT event_id, user_id, event_type, value, props, ts,
         epoch_us(ts) // 1000 AS event_ts,
         CAST(ts AS DATE) AS event_date,
         CAST(ts AS DATE) + CAST(5 + event_id % 20 AS INTEGER) AS eviction_date,
         event_id AS seq,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""

INCIDENTS = """
incidents AS (SELECT event_id AS incident_id, ts, date_trunc('hour', ts) AS hour FROM ce WHERE event_type = 'error')"""

READINGS = """
readings AS (
  SELECT ts, date_trunc('hour', ts) AS hour,
         CASE WHEN event_id % 17 = 0 THEN 'T' ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS metric
  FROM ce WHERE event_type = 'view')"""

STAGING = """
users AS (SELECT DISTINCT user_id FROM ce),
staging AS (
  SELECT 'DELETE' AS operation, user_id, CAST(NULL AS DATE) AS new_date FROM users WHERE user_id % 25 = 0
  UNION ALL SELECT 'DELETE', user_id, NULL FROM users WHERE user_id % 50 = 0
  UNION ALL SELECT 'UPDATE', user_id, DATE '2024-01-20' + CAST(user_id % 10 AS INTEGER) FROM users WHERE user_id % 25 = 1
  UNION ALL SELECT 'UPDATE', user_id, DATE '2024-01-20' + CAST(user_id % 10 + 3 AS INTEGER) FROM users WHERE user_id % 50 = 1
  UNION ALL SELECT 'UPDATE', user_id, NULL FROM users WHERE user_id % 25 = 2),
deletes AS (SELECT DISTINCT user_id FROM staging WHERE operation = 'DELETE'),
updates AS (
  SELECT user_id, max(new_date) AS new_date, count(*) AS requests FROM staging
  WHERE operation = 'UPDATE' AND new_date IS NOT NULL GROUP BY user_id)"""

FILES = """
files AS (
  SELECT 'events/' || CAST(event_date AS VARCHAR) || '/part-' || CAST(event_id % 21 AS VARCHAR) AS path,
         event_id % 21 AS bucket, event_date, max(ts) AS last_modified
  FROM ce GROUP BY 1, 2, 3)"""

LATEST_LINES = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus) AS rn
    FROM lineitem) WHERE rn = 1)"""

CLICKS = """
drawn AS (
  SELECT event_id, epoch_us(ts) // 1000000 AS sec, md5('clicks:' || CAST(event_id AS VARCHAR)) AS h FROM events),
made AS (
  SELECT event_id, sec,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % 10000 + 1 AS uid,
         CASE WHEN CAST('0x' || substr(h, 9, 8) AS BIGINT) % 201 < 100 THEN 'https://www.example.org/'
              WHEN CAST('0x' || substr(h, 9, 8) AS BIGINT) % 201 < 155 THEN 'https://docs.example.org/'
              WHEN CAST('0x' || substr(h, 9, 8) AS BIGINT) % 201 < 189 THEN 'https://www.example.org/blog'
              ELSE 'https://www.example.org/community' END AS site,
         sec - (CAST('0x' || substr(h, 17, 8) AS BIGINT) % 1801) * (CAST('0x' || substr(h, 25, 8) AS BIGINT) % 4) AS vtime
  FROM drawn)"""

BY_DAY = """SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS total_cents"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _band(low: str, high: str) -> str:
    return (
        _with(CANONICAL, INCIDENTS, READINGS)
        + f"""
SELECT count(DISTINCT i.incident_id) AS incidents,
       CAST(CAST(trunc(avg(TRY_CAST(r.metric AS DOUBLE)) * 10) AS BIGINT) AS DOUBLE) / 10 AS avg_metric,
       max(r.metric) AS max_metric,
       strftime(i.hour, '%d %b %Y %H:%M') AS hour
FROM incidents i LEFT JOIN readings r ON i.hour = r.hour
WHERE TRY_CAST(r.metric AS DOUBLE) BETWEEN {low} AND {high}
GROUP BY i.hour
ORDER BY incidents DESC, hour LIMIT 20"""
    )


def _hour(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


ORACLES: dict[str, str] = {}

# Sources, decoding, mapping

ORACLES["replay_from_offsets"] = """
WITH log AS (SELECT event_id % 6 AS p, event_id AS o FROM events),
start AS (SELECT * FROM (VALUES (0, 600), (1, 1), (2, 0), (3, 3000), (4, 10), (5, 9000)) AS t(p, first))
SELECT CAST(log.p AS INTEGER) AS partition, count(*) AS n_messages, min(o) AS first_offset, max(o) AS last_offset
FROM log JOIN start ON log.p = start.p WHERE o >= first GROUP BY log.p"""

ORACLES["decode_json_paths"] = """
SELECT event_id, user_id, event_type AS event_kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""

ORACLES["decode_json_array"] = (
    _with(CANONICAL)
    + "SELECT event_id, half, cents * half AS amount FROM ce, (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) AS t(half)"
)

ORACLES["decode_csv_positional"] = """
SELECT event_id AS collision_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS crash_at,
       'type, ' || event_type AS borough, CAST(user_id AS VARCHAR) AS zip_code,
       CAST(trunc(value) AS BIGINT) AS latitude, -CAST(trunc(value) AS BIGINT) AS longitude,
       '(' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || ', -' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || ')' AS location
FROM events"""

ORACLES["roundtrip_formats"] = (
    _with(CANONICAL)
    + """
SELECT format, CAST(event_date AS VARCHAR) AS event_date, count(*) AS n_rows,
       CAST(sum(cents) AS BIGINT) AS total_cents, count(DISTINCT user_id) AS n_users
FROM ce, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) AS f(format) GROUP BY format, event_date"""
)

ORACLES["files_to_load"] = (
    _with(CANONICAL, FILES)
    + """,
loaded AS (
  SELECT path, CAST(event_date + 1 AS TIMESTAMP) AS loaded_at FROM files WHERE bucket % 5 NOT IN (0, 1)
  UNION ALL SELECT path, CAST(event_date + 2 AS TIMESTAMP) FROM files WHERE bucket % 10 = 0)
SELECT 'once' AS mode, path FROM files WHERE path NOT IN (SELECT path FROM loaded)
UNION ALL
SELECT 'seven days', path FROM files
WHERE path NOT IN (SELECT path FROM loaded WHERE loaded_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY)"""
)

ORACLES["failed_files_recent"] = (
    _with(CANONICAL, FILES)
    + f"""
SELECT path, {_hour('last_modified')} AS last_modified FROM files
WHERE bucket % 5 = 0 AND bucket % 10 <> 0 ORDER BY files.last_modified DESC, path LIMIT 50"""
)

ORACLES["generate_clicks"] = (
    _with(CLICKS)
    + """
SELECT site, count(*) AS n_clicks, count(DISTINCT uid) AS n_users, CAST(sum(vtime) AS BIGINT) AS sum_vtime,
       max(sec - vtime) AS most_late, min(sec - vtime) AS least_late FROM made GROUP BY site"""
)

ORACLES["split_good_bad"] = """
WITH raw AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS value FROM events),
parsed AS (
  SELECT json_valid(value) AS ok,
         CASE WHEN json_valid(value) THEN CAST(json_extract_string(value, '$.k') AS BIGINT) END AS k FROM raw)
SELECT 'good' AS side, count(*) AS n_rows, CAST(coalesce(sum(k), 0) AS BIGINT) AS sum_k FROM parsed WHERE ok
UNION ALL
SELECT 'bad', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM parsed WHERE NOT ok"""

ORACLES["load_job_counters"] = """
SELECT event_type, count(*) AS total_rows,
       count(*) FILTER (WHERE event_id % 50 <> 0 AND user_id > 5) AS loaded_rows,
       count(*) FILTER (WHERE event_id % 50 <> 0 AND user_id <= 5) AS unselected_rows,
       count(*) FILTER (WHERE event_id % 50 = 0) AS error_rows
FROM events GROUP BY event_type"""

ORACLES["strict_cast_rejects"] = (
    _with(CANONICAL, READINGS)
    + """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       count(*) FILTER (WHERE TRY_CAST(metric AS DOUBLE) IS NOT NULL) AS accepted_rows,
       count(*) FILTER (WHERE TRY_CAST(metric AS DOUBLE) IS NULL) AS rejected_rows,
       count(*) AS lenient_rows,
       count(*) FILTER (WHERE TRY_CAST(metric AS DOUBLE) IS NULL) AS lenient_nulls
FROM readings GROUP BY CAST(ts AS DATE)"""
)

ORACLES["derive_event_date"] = (
    _with(CANONICAL) + "SELECT event_id, event_ts, CAST(event_date AS VARCHAR) AS event_date FROM ce"
)

ORACLES["map_columns"] = (
    _with(CANONICAL)
    + """
SELECT CAST(event_date AS VARCHAR) AS event_date, event_ts, user_id,
       CAST(eviction_date AS VARCHAR) AS eviction_date, event_ts AS row_version, 'topic' AS loaded_from FROM ce"""
)

ORACLES["table_row_counts"] = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in (
        "region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations"
    ).split()
)

ORACLES["consumer_lag"] = """
WITH ends AS (SELECT event_id % 6 AS p, max(event_id) AS e FROM events GROUP BY 1),
committed AS (
  SELECT event_type AS g, event_id % 6 AS p, max(event_id) AS c FROM events
  WHERE NOT (event_type = 'view' AND event_id % 6 = 5) GROUP BY 1, 2),
groups AS (SELECT DISTINCT g FROM committed)
SELECT groups.g AS group_id, CAST(sum(e - coalesce(c, 0)) AS BIGINT) AS lag, count(*) AS partitions
FROM groups CROSS JOIN ends LEFT JOIN committed ON committed.g = groups.g AND committed.p = ends.p GROUP BY groups.g"""

# Deduplication, layout, retention

ORACLES["dedup_latest_version"] = (
    _with(LATEST_LINES)
    + """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM latest"""
)

ORACLES["final_read_agg"] = (
    _with(LATEST_LINES)
    + """
SELECT l_returnflag, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty
FROM latest GROUP BY l_returnflag"""
)

UPSERTED = """
arrived AS (
  SELECT event_id, event_date, cents, seq FROM ce
  UNION ALL SELECT event_id, event_date, cents + 100, seq + 1000000000 FROM ce WHERE event_id % 7 = 0
  UNION ALL SELECT event_id, event_date + 1, cents + 100, seq + 1000000001 FROM ce WHERE event_id % 7 = 0),
upserted AS (
  SELECT event_id, event_date, cents FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS rn FROM arrived) WHERE rn = 1)"""

ORACLES["upsert_events"] = (
    _with(CANONICAL, UPSERTED) + "SELECT event_id, CAST(event_date AS VARCHAR) AS event_date, cents FROM upserted"
)

ORACLES["day_table_upsert"] = (
    _with(CANONICAL, UPSERTED)
    + BY_DAY
    + ", count(*) AS rows_merged, CAST(sum(cents) AS BIGINT) AS cents_merged FROM upserted GROUP BY event_date"
)

ORACLES["duplicate_rate_by_day"] = (
    _with(CANONICAL)
    + """,
delivered AS (SELECT event_id, event_date FROM ce UNION ALL SELECT event_id, event_date FROM ce WHERE event_id % 7 = 0)
SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS rows_loaded, count(DISTINCT event_id) AS rows_stored,
       count(*) - count(DISTINCT event_id) AS rows_replaced,
       round((count(*) - count(DISTINCT event_id)) / CAST(count(*) AS DOUBLE), 6) AS duplicate_rate
FROM delivered GROUP BY event_date"""
)

ORACLES["batch_ledger_dedup"] = """
WITH batches AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1),
live AS (
  SELECT h FROM batches WHERE h <= TIMESTAMP '2024-01-20' AND h > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY
  ORDER BY h DESC LIMIT 120)
SELECT strftime(h, '%Y-%m-%d %H') AS batch_hour, CAST(1 AS BIGINT) AS arrival, n AS batch_rows
FROM batches WHERE h NOT IN (SELECT h FROM live)"""

ORACLES["batch_ledger_by_time"] = """
WITH batches AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H') AS batch_hour, CAST(1 AS BIGINT) AS arrival, n AS batch_rows
FROM batches WHERE NOT (h <= TIMESTAMP '2024-01-20' AND h > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY)"""

ORACLES["merge_aggregate_states"] = (
    _with(CANONICAL)
    + """
SELECT CAST(event_date AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total,
       min(cents) AS low, max(cents) AS high, true AS users_close
FROM ce GROUP BY event_date, event_type"""
)

ORACLES["rows_per_partition"] = (
    _with(CANONICAL)
    + """
SELECT CAST(event_date AS VARCHAR) AS day, count(*) AS partition_rows FROM ce GROUP BY event_date
UNION ALL SELECT strftime(event_date, '%Y%m'), count(*) FROM ce GROUP BY 1"""
)

ORACLES["bucket_skew"] = "SELECT count(*) AS total_rows, CAST(21 AS BIGINT) AS used_buckets, true AS even FROM events"

ORACLES["partition_calendar"] = (
    _with(CANONICAL)
    + """,
calendar AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2024-01-20' - 90, DATE '2024-01-20' + 3, INTERVAL 1 DAY) AS t(d))
SELECT CAST(d AS VARCHAR) AS event_date, 'p' || strftime(d, '%Y%m%d') AS partition_name,
       d IN (SELECT event_date FROM ce) AS has_rows, d >= DATE '2024-01-20' AS upcoming
FROM calendar"""
)

ORACLES["rows_outside_window"] = (
    _with(CANONICAL)
    + """
SELECT event_id, CAST(event_date AS VARCHAR) AS event_date FROM ce
WHERE event_date NOT BETWEEN DATE '2024-01-20' - 90 AND DATE '2024-01-20' + 3"""
)

ORACLES["expired_partitions"] = (
    _with(CANONICAL)
    + """,
dated AS (
  SELECT event_date, CASE WHEN day(event_date) <= 12 THEN least(eviction_date, event_date + 9) ELSE eviction_date END AS eviction_date FROM ce),
days AS (SELECT event_date, count(*) AS n, max(eviction_date) AS last FROM dated GROUP BY event_date)
SELECT true AS inclusive, CAST(event_date AS VARCHAR) AS event_date, n AS partition_rows, CAST(last AS VARCHAR) AS last_eviction
FROM days WHERE last <= DATE '2024-01-20'
UNION ALL
SELECT false, CAST(event_date AS VARCHAR), n, CAST(last AS VARCHAR) FROM days WHERE last < DATE '2024-01-20'"""
)

ORACLES["retained_rows"] = (
    _with(CANONICAL) + BY_DAY + " FROM ce WHERE event_date >= DATE '2024-01-20' - 10 GROUP BY event_date"
)
ORACLES["day_table_retention"] = ORACLES["retained_rows"]
ORACLES["compact_partition"] = _with(CANONICAL) + BY_DAY + " FROM ce GROUP BY event_date"
ORACLES["rebucket"] = ORACLES["compact_partition"]

ORACLES["schema_evolve"] = (
    _with(CANONICAL)
    + """
SELECT event_id, event_type AS kind, CASE WHEN event_id % 17 = 0 THEN -1 ELSE cents END AS metric,
       'none' AS region, CAST(event_id % 17 = 0 AS BIGINT) AS failed FROM ce"""
)

ORACLES["not_null_violations"] = """
SELECT event_id,
       CASE WHEN event_id % 13 = 0 AND event_id % 29 = 0 THEN 'user_id, event_ts'
            WHEN event_id % 13 = 0 THEN 'user_id' ELSE 'event_ts' END AS missing
FROM events WHERE event_id % 13 = 0 OR event_id % 29 = 0"""

# Joins, aggregates, windows, reports

ORACLES["top_sites"] = "SELECT event_type AS site, count(*) AS visits FROM events GROUP BY event_type"
ORACLES["unique_users_by_site"] = (
    "SELECT event_type AS site, count(DISTINCT user_id) AS unique_users FROM events GROUP BY event_type"
)
ORACLES["visits_by_hour"] = f"""
WITH clicks AS (SELECT epoch_us(ts) // 1000000 AS vtime FROM events)
SELECT {_hour("make_timestamp((vtime - vtime % 3600) * 1000000)")} AS hour, count(*) AS visits
FROM clicks GROUP BY vtime - vtime % 3600 ORDER BY vtime - vtime % 3600 DESC LIMIT 24"""
ORACLES["events_by_hour"] = (
    _with(CANONICAL, INCIDENTS)
    + f"""SELECT {_hour('hour')} AS hour, count(*) AS incidents FROM incidents
GROUP BY incidents.hour ORDER BY incidents.hour LIMIT 48"""
)
ORACLES["avg_text_metric_by_hour"] = (
    _with(CANONICAL, READINGS)
    + f"""SELECT {_hour('hour')} AS hour, round(avg(TRY_CAST(metric AS DOUBLE)), 6) AS avg_metric FROM readings
GROUP BY readings.hour ORDER BY readings.hour LIMIT 48"""
)
ORACLES["errors_in_low_range"] = _band("0.0", "20.0")
ORACLES["errors_in_mid_range"] = _band("20.0", "60.0")

ORACLES["hourly_left_join"] = (
    _with(CANONICAL, INCIDENTS, READINGS)
    + """
SELECT i.incident_id, count(r.metric) AS readings,
       round(coalesce(avg(TRY_CAST(r.metric AS DOUBLE)), -1.0), 6) AS avg_metric,
       coalesce(max(r.metric), 'none') AS max_metric
FROM incidents i LEFT JOIN (SELECT * FROM readings WHERE metric <> 'T') r ON i.hour = r.hour
GROUP BY i.incident_id"""
)

ORACLES["broadcast_join"] = """
SELECT n_name, count(*) AS customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS balance_cents
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""

ORACLES["shuffle_hash_join"] = """
SELECT o_orderstatus, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus"""

ORACLES["colocated_join"] = """
SELECT o_orderpriority, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""
ORACLES["salted_lookup_join"] = ORACLES["colocated_join"]
ORACLES["bucket_shuffle_join"] = ORACLES["colocated_join"]

ORACLES["storage_audit"] = (
    _with(CANONICAL)
    + """,
units AS (SELECT DISTINCT CAST(event_date AS VARCHAR) || '/' || CAST(event_id % 21 AS VARCHAR) AS path, event_id % 21 AS b FROM ce),
listed AS (SELECT path FROM units WHERE b % 7 <> 0),
registered AS (SELECT path FROM units WHERE b % 11 <> 0)
SELECT coalesce(l.path, r.path) AS path,
       CASE WHEN l.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'orphan' ELSE 'ok' END AS status
FROM listed l FULL JOIN registered r ON l.path = r.path"""
)

ORACLES["approx_users"] = """
SELECT event_type, count(DISTINCT user_id) AS exact_users, true AS approx_close, true AS sketch_close
FROM events GROUP BY event_type"""

ORACLES["bitmap_distinct"] = "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"

ORACLES["set_overlap"] = """
WITH s AS (SELECT DISTINCT event_type, user_id FROM events),
kinds AS (SELECT DISTINCT event_type FROM s),
pairs AS (SELECT a.event_type AS l, b.event_type AS r FROM kinds a JOIN kinds b ON a.event_type < b.event_type),
both_sets AS (
  SELECT l, r, count(*) AS n FROM pairs JOIN s x ON x.event_type = l JOIN s y ON y.event_type = r AND y.user_id = x.user_id GROUP BY l, r),
either AS (
  SELECT l, r, count(DISTINCT user_id) AS n FROM pairs JOIN s ON s.event_type = l OR s.event_type = r GROUP BY l, r)
SELECT either.l AS left_set, either.r AS right_set, coalesce(both_sets.n, 0) AS in_both, either.n AS in_either
FROM either LEFT JOIN both_sets ON both_sets.l = either.l AND both_sets.r = either.r"""

ORACLES["layout_summary"] = (
    _with(CANONICAL)
    + """,
parts AS (
  SELECT event_date, event_id % 21 AS bucket, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS versions
  FROM ce GROUP BY 1, 2)
SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS units, CAST(sum(n) AS BIGINT) AS row_count,
       round(avg(versions), 1) AS avg_versions, min(versions) AS min_versions, max(versions) AS max_versions,
       count(*) FILTER (WHERE day(event_date) % 7 = 0 AND bucket = 20) AS bad_units,
       max(versions) > 14 AS compaction_lagging
FROM parts GROUP BY event_date"""
)

ORACLES["part_pressure"] = (
    _with(CANONICAL)
    + """,
counted AS (SELECT event_date, count(DISTINCT date_trunc('minute', ts)) AS files FROM ce GROUP BY event_date)
SELECT CAST(event_date AS VARCHAR) AS event_date, files,
       CASE WHEN files >= 320 THEN 'stop' WHEN files >= 290 THEN 'slow' ELSE 'ok' END AS level FROM counted"""
)

ORACLES["hit_ratio"] = (
    _with(CANONICAL)
    + """,
counted AS (
  SELECT event_date, count(*) FILTER (WHERE event_type = 'click') AS hits,
         count(*) FILTER (WHERE event_type = 'view') AS misses FROM ce GROUP BY event_date)
SELECT CAST(event_date AS VARCHAR) AS event_date, hits, misses,
       round(hits / CAST(nullif(hits + misses, 0) AS DOUBLE) * 100, 1) AS hit_rate_pct FROM counted"""
)

ORACLES["avg_row_chars"] = """
SELECT lang, CAST(sum(length(text)) AS BIGINT) AS total_size, count(*) AS total_rows,
       round(sum(length(text)) / CAST(count(*) AS DOUBLE), 6) AS size_per_row
FROM documents GROUP BY lang"""

ORACLES["daily_event_counts"] = (
    _with(CANONICAL)
    + """SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS event_count,
count(DISTINCT user_id) AS unique_users FROM ce GROUP BY event_date"""
)

ORACLES["rollup_equals_base"] = """
SELECT event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, true AS matches
FROM events GROUP BY event_type"""

ORACLES["running_difference"] = (
    _with(CANONICAL)
    + """
SELECT event_id, user_id,
       coalesce(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS difference FROM ce"""
)

ORACLES["running_accumulate"] = (
    _with(CANONICAL)
    + """
SELECT event_id, user_id,
       CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS accumulated
FROM ce"""
)

ORACLES["job_alerts"] = (
    _with(CANONICAL)
    + """,
checks AS (
  SELECT event_type AS job_name, epoch_us(ts) // 3600000000 AS checked_at,
         count(*) FILTER (WHERE cents > 1500) AS error_rows FROM ce GROUP BY 1, 2),
lagged AS (
  SELECT *, lag(error_rows, 1) OVER w AS one, lag(error_rows, 2) OVER w AS two
  FROM checks WINDOW w AS (PARTITION BY job_name ORDER BY checked_at))
SELECT job_name, checked_at, error_rows,
       CASE WHEN checked_at % 97 = 0 THEN 'page' WHEN error_rows > one AND one > two THEN 'warn'
            WHEN checked_at % 5 = 0 THEN 'info' ELSE 'ok' END AS alert
FROM lagged"""
)

ORACLES["partition_report"] = (
    _with(CANONICAL)
    + """
SELECT 'p' || strftime(event_date, '%Y%m%d') AS partition_name, count(*) AS row_count,
       CAST(sum(length(props)) * 1000000 AS BIGINT) AS data_bytes,
       round(sum(length(props)) * 1000000 / 1073741824.0, 2) AS data_gb
FROM ce GROUP BY event_date"""
)

ORACLES["capacity_projection"] = (
    _with(CANONICAL)
    + """,
rates AS (SELECT event_type, count(*) // count(DISTINCT event_date) AS rows_per_day FROM ce GROUP BY event_type),
grid AS (SELECT * FROM rates, (VALUES (50), (100), (200)) AS b(bytes_per_row), (VALUES (30), (90)) AS d(retention_days))
SELECT event_type, rows_per_day, CAST(bytes_per_row AS BIGINT) AS bytes_per_row, CAST(retention_days AS BIGINT) AS retention_days,
       round(CAST(rows_per_day * bytes_per_row * retention_days AS DOUBLE), 2) AS total_bytes,
       round(CAST(rows_per_day * bytes_per_row * retention_days AS DOUBLE) * 0.25, 2) AS cache_bytes,
       round(CAST(rows_per_day * bytes_per_row * retention_days AS DOUBLE) * CAST(0.25 AS DOUBLE) * CAST(1.15 AS DOUBLE), 2) AS volume_bytes
FROM grid"""
)

ORACLES["ingest_rate"] = """
WITH s AS (SELECT epoch_us(ts) // 1000000 AS sec FROM events),
minutes AS (SELECT sec - sec % 60 AS bucket_start, count(*) AS n_rows FROM s GROUP BY 1)
SELECT bucket_start, n_rows, round(n_rows / CAST(60 AS DOUBLE), 6) AS rows_per_second,
       round(n_rows / CAST(60 AS DOUBLE) * 10 / 6, 6) AS rows_per_flush FROM minutes"""

# Deletes and updates

ORACLES["delete_user"] = _with(CANONICAL) + BY_DAY + " FROM ce WHERE user_id <> 8 GROUP BY event_date"
ORACLES["rows_matching_batch"] = (
    _with(CANONICAL, STAGING) + "SELECT event_id, user_id FROM ce WHERE user_id IN (SELECT user_id FROM deletes)"
)
ORACLES["survivors_after_delete"] = (
    _with(CANONICAL, STAGING)
    + BY_DAY
    + " FROM ce WHERE user_id NOT IN (SELECT user_id FROM deletes) GROUP BY event_date"
)
ORACLES["update_where"] = (
    _with(CANONICAL)
    + """SELECT event_id, user_id,
CAST(CASE WHEN user_id = 8 THEN DATE '2024-01-20' ELSE eviction_date END AS VARCHAR) AS eviction_date FROM ce"""
)
ORACLES["update_from_staging"] = (
    _with(CANONICAL, STAGING)
    + """SELECT event_id, ce.user_id, CAST(coalesce(new_date, eviction_date) AS VARCHAR) AS eviction_date
FROM ce LEFT JOIN updates ON ce.user_id = updates.user_id"""
)
ORACLES["staging_conflicts"] = (
    _with(CANONICAL, STAGING)
    + "SELECT user_id, CAST(new_date AS VARCHAR) AS new_eviction_date, requests FROM updates WHERE requests > 1"
)
ORACLES["withdraw_consent"] = (
    _with(CANONICAL, STAGING)
    + """SELECT event_id,
CASE WHEN user_id IN (SELECT user_id FROM staging WHERE operation = 'UPDATE') THEN 'withdrawn' ELSE 'given' END AS consent_status
FROM ce"""
)
ORACLES["pseudonymize"] = """
SELECT event_id, CASE WHEN user_id = 8 THEN -1 ELSE user_id END AS user_id,
       CASE WHEN user_id = 8 THEN sha256('pepper:' || CAST(user_id AS VARCHAR)) ELSE 'none' END AS user_token
FROM events"""
ORACLES["delete_impact_plan"] = (
    _with(CANONICAL, STAGING)
    + """,
units AS (
  SELECT DISTINCT user_id, event_date, user_id % 7 AS bucket FROM ce WHERE user_id IN (SELECT user_id FROM deletes))
SELECT 'user ' || CAST(user_id AS VARCHAR) AS scope, count(*) AS units FROM units GROUP BY user_id
UNION ALL SELECT 'one by one', count(*) FROM units
UNION ALL SELECT 'as a batch', count(*) FROM (SELECT DISTINCT event_date, bucket FROM units)"""
)
ORACLES["physical_removal_check"] = (
    _with(CANONICAL, STAGING)
    + """SELECT user_id, count(*) AS rows_before, count(*) AS rows_in_files,
CAST(0 AS BIGINT) AS rows_live, CAST(0 AS BIGINT) AS rows_left
FROM ce WHERE user_id IN (SELECT user_id FROM deletes) GROUP BY user_id"""
)
ORACLES["nightly_batch"] = (
    _with(CANONICAL, STAGING)
    + """
SELECT ce.user_id, count(*) AS n_rows, CAST(max(coalesce(new_date, eviction_date)) AS VARCHAR) AS last_eviction
FROM ce LEFT JOIN updates ON ce.user_id = updates.user_id
WHERE ce.user_id NOT IN (SELECT user_id FROM deletes) GROUP BY ce.user_id
UNION ALL SELECT user_id, CAST(0 AS BIGINT), 'removed' FROM deletes"""
)
ORACLES["sla_report"] = (
    _with(CANONICAL, STAGING)
    + """
SELECT user_id, CASE WHEN user_id % 75 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(user_id % 40 AS DOUBLE) END AS hours_taken,
       user_id % 75 <> 0 AND user_id % 40 <= 24 AS within_sla FROM deletes"""
)

# Scalar functions

ORACLES["scalar_dates"] = (
    _with(CANONICAL)
    + f"""
SELECT event_id, {_hour("date_trunc('hour', ts)")} AS hour, strftime(ts, '%d %b %Y %H:%M') AS label,
       {_hour("date_trunc('minute', ts)")} AS parsed, 'none' AS not_parsed,
       {_hour("date_trunc('hour', ts)")} AS from_seconds,
       strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS millis,
       CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS day_number, CAST(strftime(ts, '%Y%m') AS BIGINT) AS month_number,
       {_hour("time_bucket(INTERVAL 15 MINUTE, ts)")} AS quarter_hour,
       CAST(event_date + 90 AS VARCHAR) AS plus_90
FROM ce"""
)

ORACLES["scalar_time_slots"] = (
    _with(CANONICAL)
    + f""",
spans AS (SELECT epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + (cents * 60) // 100 AS b FROM ce),
slots AS (SELECT unnest(generate_series(a - a % 1800, b - b % 1800, 1800)) AS s FROM spans)
SELECT {_hour("make_timestamp(s * 1000000)")} AS slot, count(*) AS n_events FROM slots GROUP BY s"""
)

ORACLES["scalar_numbers"] = (
    _with(CANONICAL)
    + """
SELECT event_id, round(value, 1) AS rounded, CAST(CAST(trunc(value * 10) AS BIGINT) AS DOUBLE) / 10 AS cut,
       CAST(CAST(trunc(value - 50) AS BIGINT) AS DOUBLE) AS cut_signed, user_id % 7 AS remainder,
       CASE WHEN event_type < 'n' THEN 12.5 ELSE CAST(-1 AS DOUBLE) END AS as_number,
       CASE WHEN cents > 2000 THEN 'large' ELSE 'small' END AS size_class
FROM ce"""
)

ORACLES["scalar_strings"] = """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, concat_ws('-', lang, source) AS origin,
       lang || ':' || CAST(doc_id AS VARCHAR) AS label, regexp_extract(text, '[0-9]+') AS first_number,
       CAST(len(regexp_extract_all(text, '[aeiou]')) AS BIGINT) AS vowels,
       CAST(levenshtein(lang, source) AS BIGINT) AS distance,
       md5(hex(encode(text))) AS hex_md5, md5(to_base64(encode(text))) AS base64_md5
FROM documents"""

ORACLES["scalar_json"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"

ORACLES["readable_size"] = """
WITH sized AS (
  SELECT doc_id, length(text) * factor AS b FROM documents,
    (VALUES (CAST(1 AS BIGINT)), (1000), (1000000), (1000000000)) AS f(factor))
SELECT doc_id, CAST(b AS BIGINT) AS bytes,
  CASE WHEN b >= 1152921504606846976 THEN CAST(CAST(round(b / 1152921504606846976.0::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' EiB'
       WHEN b >= 1125899906842624 THEN CAST(CAST(round(b / 1125899906842624.0::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' PiB'
       WHEN b >= 1099511627776 THEN CAST(CAST(round(b / 1099511627776.0::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' TiB'
       WHEN b >= 1073741824 THEN CAST(CAST(round(b / 1073741824.0::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' GiB'
       WHEN b >= 1048576 THEN CAST(CAST(round(b / 1048576.0::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' MiB'
       WHEN b >= 1024 THEN CAST(CAST(round(b / 1024.0::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' KiB'
       ELSE CAST(CAST(b AS DECIMAL(20,2)) AS VARCHAR) || ' B' END AS readable
FROM sized"""

# Streams

ORACLES["stream_equals_batch"] = (
    _with(CANONICAL)
    + """,
stored AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_date + 1 ELSE event_date END AS event_date,
         CASE WHEN event_id % 7 = 0 THEN cents + 100 ELSE cents END AS cents
  FROM ce WHERE user_id > 0 AND (event_id % 7 = 0 OR event_id % 50 <> 0))
"""
    + BY_DAY
    + """, 'stored' AS kind FROM stored GROUP BY event_date
UNION ALL
SELECT CAST(event_date AS VARCHAR), count(*), CAST(sum(event_id) AS BIGINT), 'dead letters'
FROM ce WHERE event_id % 50 = 0 GROUP BY event_date"""
)

ORACLES["stream_hourly_clicks"] = (
    _with(CLICKS)
    + f"""
SELECT {_hour("make_timestamp((vtime - vtime % 3600) * 1000000)")} AS hour, site, count(*) AS visits
FROM made GROUP BY vtime - vtime % 3600, site"""
)

ORACLES["stream_late_clicks"] = ORACLES["stream_hourly_clicks"]

ORACLES["stream_first_arrivals"] = (
    _with(CLICKS) + "SELECT site, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS sum_ids FROM made GROUP BY site"
)

# Message logs, plain folders and streams that load them

ORACLES["message_stream_bounds"] = """
WITH log AS (SELECT event_id % 6 AS part, event_id // 6 AS off FROM events),
share AS (SELECT ((max(event_id) // 6) + 1) // 4 + 1 AS n FROM events),
starts AS (SELECT * FROM (VALUES (0, 7), (2, 0), (5, 3)) AS s(part, first))
SELECT CAST((off - first) // n AS BIGINT) AS batch_id, CAST(log.part AS BIGINT) AS partition, min(off) AS first_offset,
       max(off) AS last_offset, count(*) AS n_rows
FROM log JOIN starts ON log.part = starts.part, share WHERE off >= first GROUP BY 1, 2"""

# Of the messages with valid JSON those of users above 0; the others by the day of the message.
ORACLES["load_to_folders"] = (
    _with(CANONICAL)
    + BY_DAY
    + """, 'stored' AS kind FROM ce WHERE user_id > 0 AND event_id % 50 <> 0 GROUP BY event_date
UNION ALL
SELECT CAST(event_date AS VARCHAR), count(*), CAST(sum(event_id // 6) AS BIGINT), 'dead letters'
FROM ce WHERE event_id % 50 = 0 GROUP BY event_date"""
)
ORACLES["replayed_batch"] = ORACLES["load_to_folders"]
ORACLES["pause_and_resume"] = ORACLES["load_to_folders"]

ORACLES["error_gate"] = """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE user_id > 0 AND event_id % 50 <> 0) AS loaded_rows,
       count(*) FILTER (WHERE event_id % 50 = 0) AS error_rows, true AS stopped, CAST(1 AS BIGINT) AS paused_batches FROM events"""

ORACLES["job_status"] = """
SELECT 'job_status' AS job_name, count(*) AS input_rows, true AS many_batches,
       count(*) FILTER (WHERE event_id % 50 = 0) AS error_rows, CAST(6 AS BIGINT) AS partitions FROM events"""

ORACLES["stream_newest_wins"] = ORACLES["upsert_events"]

ORACLES["two_sources"] = (
    _with(CANONICAL)
    + """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN cents + 100 ELSE cents END AS cents,
       CASE WHEN event_id % 2 = 0 THEN 'files' ELSE 'events' END AS topic
FROM ce WHERE event_id % 2 = 0 OR event_id % 50 <> 0"""
)

ORACLES["file_stream_rows"] = (
    _with(CANONICAL)
    + """
SELECT event_type, CAST(event_id % 2 AS VARCHAR) AS half, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS total_cents
FROM ce GROUP BY 1, 2"""
)

ORACLES["load_files_once"] = (
    _with(CANONICAL)
    + """
SELECT count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS total_cents, CAST(1 AS BIGINT) AS failed_files, false AS loaded_twice FROM ce"""
)

ORACLES["user_lookup"] = (
    _with(CANONICAL)
    + """
SELECT event_id, user_id, CAST(event_date AS VARCHAR) AS event_date FROM ce
WHERE user_id IN (SELECT DISTINCT user_id FROM ce ORDER BY user_id LIMIT 5)"""
)

ORACLES["folder_removal_proof"] = (
    _with(CANONICAL, STAGING)
    + """
SELECT user_id, count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_left
FROM ce WHERE user_id IN (SELECT user_id FROM deletes) GROUP BY user_id
UNION ALL SELECT CAST(-1 AS BIGINT), count(*), CAST(0 AS BIGINT) FROM ce WHERE user_id NOT IN (SELECT user_id FROM deletes)"""
)

ORACLES["folder_delete_user"] = ORACLES["delete_user"]

ORACLES["folder_compact"] = (
    _with(CANONICAL) + BY_DAY + ", CAST(1 AS BIGINT) AS files FROM ce GROUP BY event_date"
)

ORACLES["folder_report"] = (
    _with(CANONICAL)
    + """,
written AS (
  SELECT event_date, count(*) AS n, count(DISTINCT event_id % 2) AS files FROM ce GROUP BY event_date)
SELECT 'p' || strftime(event_date, '%Y%m%d') AS partition_name, n AS row_count, files,
       CASE WHEN files >= 3 THEN 'stop' WHEN files >= 2 THEN 'slow' ELSE 'ok' END AS level, true AS has_bytes FROM written"""
)

# A file a day: the days up to the 10th were registered, the 3rd was written anew, later days came after.
ORACLES["folder_audit"] = (
    _with(CANONICAL)
    + """,
days AS (SELECT DISTINCT event_date FROM ce),
found AS (
  SELECT 'ok' AS status FROM days WHERE day(event_date) <= 10 AND day(event_date) <> 3
  UNION ALL SELECT 'orphan' FROM days WHERE day(event_date) > 10 OR day(event_date) = 3
  UNION ALL SELECT 'missing' FROM days WHERE day(event_date) = 3)
SELECT status, count(*) AS files FROM found GROUP BY status"""
)

ORACLES["expired_from_footers"] = (
    _with(CANONICAL)
    + """,
dated AS (
  SELECT event_date, CASE WHEN event_id = (SELECT min(event_id) FROM ce WHERE day(event_date) = 2) THEN NULL
         WHEN day(event_date) <= 12 THEN least(eviction_date, event_date + 9) ELSE eviction_date END AS eviction_date FROM ce),
days AS (
  SELECT event_date, count(*) AS n, max(eviction_date) AS last FROM dated GROUP BY event_date
  HAVING count(*) = count(eviction_date))
SELECT true AS inclusive, CAST(event_date AS VARCHAR) AS event_date, n AS partition_rows, CAST(last AS VARCHAR) AS last_eviction
FROM days WHERE last <= DATE '2024-01-20'
UNION ALL
SELECT false, CAST(event_date AS VARCHAR), n, CAST(last AS VARCHAR) FROM days WHERE last < DATE '2024-01-20'"""
)

ORACLES["delete_plan_bytes"] = (
    _with(CANONICAL, STAGING)
    + """,
units AS (SELECT DISTINCT user_id, event_date FROM ce WHERE user_id IN (SELECT user_id FROM deletes)),
crowd AS (SELECT event_date, count(*) AS users FROM units GROUP BY event_date),
others AS (
  SELECT a.user_id, count(DISTINCT b.user_id) - 1 AS n FROM units a JOIN units b USING (event_date) GROUP BY a.user_id)
SELECT units.user_id AS "user", count(*) AS units, count(*) FILTER (WHERE users > 1) AS shared_units,
       any_value(others.n) AS shared_users, true AS has_bytes
FROM units JOIN crowd USING (event_date) JOIN others ON units.user_id = others.user_id GROUP BY units.user_id"""
)

ORACLES["rollup_sketch_users"] = (
    _with(CANONICAL)
    + """,
grains AS (
  SELECT CAST(event_date AS VARCHAR) AS grain, user_id FROM ce
  UNION ALL SELECT strftime(event_date, '%Y%m') || '/' || event_type, user_id FROM ce
  UNION ALL SELECT strftime(event_date, '%Y%m'), user_id FROM ce)
SELECT grain, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, true AS close FROM grains GROUP BY grain"""
)

ORACLES["decode_variant_paths"] = ORACLES["decode_json_paths"]

ORACLES["sized_bucket_join"] = (
    _with(CANONICAL)
    + """,
users AS (SELECT user_id, max(event_id) AS last_event FROM ce GROUP BY user_id)
SELECT 'all' AS rows_of, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS total_cents,
       CAST(sum(last_event) AS BIGINT) AS last_events, true AS more_buckets FROM ce JOIN users USING (user_id)
UNION ALL
SELECT 'clicks', count(*), CAST(sum(cents) AS BIGINT), CAST(sum(last_event) AS BIGINT), true
FROM ce JOIN users USING (user_id) WHERE event_type = 'click'"""
)

ORACLES["table_lifecycle"] = """
WITH n AS (SELECT count(*) AS every, count(*) FILTER (WHERE event_id % 2 = 0) AS even FROM events)
SELECT CAST(0 AS BIGINT) AS step, 'created' AS what, CAST(0 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_new FROM n
UNION ALL SELECT 1, 'inserted with defaults', even, even FROM n
UNION ALL SELECT 2, 'inserted', every, even FROM n
UNION ALL SELECT 3, 'column added', every, 0 FROM n
UNION ALL SELECT 4, 'emptied', 0, 0 FROM n
UNION ALL SELECT 5, 'dropped', 0, 0 FROM n"""

ORACLES["two_phase_users"] = (
    _with(CANONICAL)
    + """
SELECT event_type, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS total_cents, count(DISTINCT user_id) AS unique_users
FROM ce GROUP BY event_type"""
)
