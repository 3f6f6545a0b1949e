"""SQL twins of the registered queries, written from what they must mean.

They run over the given tables without any part of the Spark code: funnels are
plain range joins, anchors are recursive.
"""

from __future__ import annotations

# --- derived inputs ----------------------------------------------------------

EVENTS = """
analytics_events AS (
  SELECT e.event_id, e.ts, 'proj_' || CAST(e.user_id % 4 AS VARCHAR) AS project_id,
    e.event_type AS event,
    CASE WHEN e.event_id % 20 = 0 THEN '' ELSE 'user_' || CAST(e.user_id AS VARCHAR) END
      AS user_id,
    n.n_name AS country, 'city_' || CAST(c.c_nationkey AS VARCHAR) AS city,
    CASE e.event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END
      AS device_type,
    CASE e.user_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' ELSE 'Safari' END AS browser,
    CASE e.user_id % 2 WHEN 0 THEN 'Windows' ELSE 'macOS' END AS os,
    e.props AS properties
  FROM events e
  JOIN customer c ON c.c_custkey = e.user_id
  JOIN nation n ON n.n_nationkey = c.c_nationkey
)"""

ARRIVALS = (
    EVENTS
    + """,
arrivals AS (
  SELECT a.*, d.seq, a.ts + to_seconds(d.delay) AS arrival_ts,
    CAST(floor(epoch_us(a.ts) / 1000) AS BIGINT) AS ts_ms
  FROM analytics_events a
  JOIN (VALUES (0, 0, 1), (1, 30, 10), (2, 60, 30)) d(seq, delay, every)
    ON a.event_id % d.every = 0
),
keyed AS (
  SELECT *, sha256(project_id || ':' || user_id || ':' || CAST(ts_ms AS VARCHAR) || ':' || event)
    AS dedup_key
  FROM arrivals
)"""
)

PROJECTS = """
projects AS (
  SELECT 'proj_' || CAST(r_regionkey AS VARCHAR) AS project_id,
    'org_' || CAST(r_regionkey % 2 AS VARCHAR) AS org_id
  FROM region
)"""

REQUESTS = """
requests AS (
  SELECT event_id, ts AS arrival_ts,
    CASE WHEN event_id % 14 = 0 THEN 'sk_test_' || k WHEN event_id % 7 = 0 THEN k || 'x' ELSE k END
      AS api_key
  FROM (
    SELECT event_id, ts,
      'pk_live_' || substr(sha256('key-' || CAST(user_id % 4 AS VARCHAR)), 1, 24) AS k
    FROM events
  )
)"""

KEYS = (
    PROJECTS
    + ","
    + REQUESTS
    + """,
api_keys AS (
  SELECT project_id, 'pk_live_' || substr(sha256('key-' || substr(project_id, 6)), 1, 24) AS api_key,
    CASE WHEN project_id = 'proj_3' THEN TIMESTAMP '2024-01-15 00:00:00' END AS expires_at
  FROM projects
)"""
)

BODIES = (
    EVENTS
    + """,
parts AS (
  SELECT event_id, ts, event_id % 40 AS c, event, project_id, user_id, properties,
    CAST(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS VARCHAR) AS ms
  FROM analytics_events
),
good AS (
  SELECT *, '{"event":"' || event || '","projectId":"' || project_id || '","userId":"' || user_id
    || '","timestamp":' || ms || ',"properties":' || properties || '}' AS g,
    '{"projectId":"' || project_id || '","timestamp":' || ms || '}' AS no_event
  FROM parts
),
bodies AS (
  SELECT event_id, ts AS arrival_ts, c, event, project_id, user_id, ms,
    CASE c
      WHEN 1 THEN no_event
      WHEN 2 THEN '{"event":"' || event || '","projectId":"' || project_id || '","timestamp":"'
        || ms || '"}'
      WHEN 3 THEN '{"event":"' || event || '","projectId":"' || project_id
        || '","userId":null,"timestamp":' || ms || '}'
      WHEN 4 THEN '{"event":"' || event || '","projectId":"' || project_id || '","timestamp":'
        || ms || ',"properties":[1]}'
      WHEN 5 THEN '{"event":7,"projectId":"' || project_id || '","timestamp":' || ms || '}'
      WHEN 6 THEN 'null'
      WHEN 7 THEN substr(g, 1, 20)
      WHEN 8 THEN '[' || g || ',' || no_event || ']'
      WHEN 9 THEN '[' || g || ',5]'
      ELSE g END AS body
  FROM good
),
docs AS (
  SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS doc FROM bodies
)"""
)

AGENT_TEXTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko)"
    " Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15"
    " (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Linux; Android 13; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko)"
    " Chrome/119.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15"
    " (KHTML, like Gecko) Version/17.0 Safari/605.1.15",
)

TRACKED = f"""
tracked AS (
  SELECT e.event_id, e.ts, 'proj_' || CAST(e.user_id % 4 AS VARCHAR) AS project_id,
    'user_' || CAST(e.user_id AS VARCHAR) AS user_id,
    c.c_nationkey AS nation, e.event_id % 256 AS third,
    CASE WHEN e.event_id % 5 = 1 THEN 'b' WHEN e.event_id % 5 = 2 THEN 'b' ELSE 'a' END AS source,
    '10.' || CAST(c.c_nationkey AS VARCHAR) || '.' || CAST(e.event_id % 256 AS VARCHAR) || '.'
      || CAST(e.user_id % 256 AS VARCHAR) AS address,
    CASE e.event_id % 6
      WHEN 0 THEN '{AGENT_TEXTS[0]}' WHEN 1 THEN '{AGENT_TEXTS[1]}'
      WHEN 2 THEN '{AGENT_TEXTS[2]}' WHEN 3 THEN '{AGENT_TEXTS[3]}'
      WHEN 4 THEN '{AGENT_TEXTS[4]}' END AS agent
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
),
located AS (
  SELECT t.*, n.n_name AS country,
    CASE WHEN n.n_nationkey IS NOT NULL THEN 'city_' || CAST(n.n_nationkey AS VARCHAR) END AS city
  FROM tracked t LEFT JOIN nation n ON n.n_nationkey = t.nation AND t.third < 192
)"""

LETTERS = (
    EVENTS
    + """,
letters AS (
  SELECT event_id AS id,
    CASE event_id % 2 WHEN 0 THEN 'raw-events' ELSE 'enriched-events' END AS original_topic,
    CAST(event_id % 8 AS INTEGER) AS original_partition,
    CAST(event_id AS VARCHAR) AS original_offset, project_id AS original_key,
    properties AS original_value,
    CASE event_id % 3 WHEN 0 THEN 'Schema validation failed'
      WHEN 1 THEN 'Project schema validation failed' ELSE 'Connection lost' END
      || ': ' || CAST(event_id AS VARCHAR) AS reason,
    ts AS created_at
  FROM analytics_events WHERE event = 'error'
),
status_log AS (
  SELECT id, 0 AS seq, 'pending' AS status, NULL AS last_error, created_at AS at FROM letters
  UNION ALL
  SELECT id, 1, 'retrying', NULL, created_at + INTERVAL 1 MINUTE FROM letters
    WHERE id % 3 = 0 OR (id % 11 = 0 AND id % 7 <> 0)
  UNION ALL
  SELECT id, 2, 'retried', NULL, created_at + INTERVAL 2 MINUTE FROM letters WHERE id % 3 = 0
  UNION ALL
  SELECT id, 1, 'discarded', NULL, created_at + INTERVAL 1 MINUTE FROM letters
    WHERE id % 3 <> 0 AND id % 7 = 0
  UNION ALL
  SELECT id, 2, 'pending', 'broker down', created_at + INTERVAL 2 MINUTE FROM letters
    WHERE id % 3 <> 0 AND id % 7 <> 0 AND id % 11 = 0
),
states AS (
  SELECT l.*,
    (SELECT s.status FROM status_log s WHERE s.id = l.id ORDER BY s.seq DESC LIMIT 1) AS status,
    (SELECT s.at FROM status_log s WHERE s.id = l.id ORDER BY s.seq DESC LIMIT 1) AS updated_at,
    (SELECT CAST(count(*) AS BIGINT) FROM status_log s WHERE s.id = l.id AND s.status = 'retried')
      AS retry_count,
    (SELECT max(s.last_error) FROM status_log s WHERE s.id = l.id) AS last_error
  FROM letters l
)"""
)

STAGES = (
    ARRIVALS
    + """,
stages AS (
  SELECT event_id, arrival_ts AS passed_at, unnest(
    CASE WHEN seq = 1 THEN ['received', 'deduped']
      WHEN event = 'error' THEN ['received', 'rejected', 'dead_lettered']
      ELSE ['received', 'valid', 'processed', 'stored'] END) AS stage
  FROM arrivals
),
counted AS (
  SELECT stage, date_trunc('minute', passed_at) AS bucket, CAST(count(*) AS BIGINT) AS n
  FROM stages GROUP BY 1, 2
)"""
)

HISTOGRAM = """
timed AS (
  SELECT event_type AS stage, CAST(round(value * 10000) AS BIGINT) / 1000.0 AS lag FROM events
),
bounds AS (
  SELECT unnest([10.0::DOUBLE, 50, 100, 250, 500, 1000, 5000, 'Infinity'::DOUBLE]) AS le
),
histogram AS (
  SELECT stage, le, CAST(count(*) FILTER (WHERE lag <= le) AS BIGINT) AS cumulative_count
  FROM timed CROSS JOIN bounds GROUP BY 1, 2
)"""

ROLLUPS = (
    EVENTS
    + """,
days AS (
  SELECT project_id, event, CAST(ts AS DATE) AS day,
    count(DISTINCT user_id) FILTER (WHERE user_id <> '') AS uniques
  FROM analytics_events GROUP BY 1, 2, 3
),
rollups AS (
  SELECT a.project_id, a.event, date_trunc('minute', a.ts) AS bucket,
    CAST(count(*) AS BIGINT) AS count, CAST(max(d.uniques) AS BIGINT) AS unique_users,
    CAST(count(DISTINCT a.user_id) FILTER (WHERE a.user_id <> '') AS BIGINT) AS unique_users_bucket
  FROM analytics_events a
  JOIN days d ON d.project_id = a.project_id AND d.event = a.event AND d.day = CAST(a.ts AS DATE)
  GROUP BY 1, 2, 3
)"""
)

FROM, TO = "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-21 23:59:59'"


def _anchors(source: str, keys: str, ts: str, ttl: str) -> str:
    """Recursive anchors: each step finds the first event at or after the end."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"e.{k} = a.{k}" for k in names)
    listed = ", ".join(f"a.{k}" for k in names)
    return f"""
anchors AS (
  SELECT {keys}, min({ts}) AS anchor FROM {source} GROUP BY {keys}
  UNION ALL
  SELECT {listed}, min(e.{ts}) FROM anchors a
  JOIN {source} e ON {same} AND e.{ts} >= a.anchor + INTERVAL {ttl}
  GROUP BY {listed}, a.anchor
)"""


def _metrics(grain: str, where: str = "TRUE", keys: str = "project_id, event, ") -> str:
    groups = ", ".join(str(i + 1) for i in range(keys.count(",") + 1))
    return f"""WITH {ROLLUPS}
SELECT {keys}date_trunc('{grain}', bucket)::TIMESTAMP AS bucket,
  CAST(sum(count) AS BIGINT) AS count, CAST(sum(unique_users) AS BIGINT) AS unique_users
FROM rollups WHERE {where} GROUP BY {groups}"""


def _funnel(
    steps: tuple[str, ...], window: str, first: str = "TRUE", project: str | None = None
) -> str:
    values = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(steps, steps[1:])))
    named = ", ".join(f"'{s}'" for s in sorted(set(steps)))
    only = "TRUE" if project is None else f"project_id = '{project}'"
    column = "p.project_id, " if project is None else ""
    return f"""WITH {EVENTS},
pairs(pair, "from", "to") AS (VALUES {values}),
present AS (SELECT DISTINCT project_id FROM analytics_events WHERE event IN ({named}) AND {only}),
hits AS (
  SELECT DISTINCT a.project_id, q.pair, a.user_id
  FROM pairs q
  JOIN analytics_events a ON a.event = q."from"
  JOIN analytics_events b ON b.event = q."to" AND b.user_id = a.user_id
    AND b.project_id = a.project_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {window}
  WHERE {first.replace("ts", "a.ts")}
)
SELECT {column}CAST(q.pair AS INTEGER) AS pair, q."from", q."to", CAST(count(h.user_id) AS BIGINT) AS users
FROM present p CROSS JOIN pairs q
LEFT JOIN hits h ON h.project_id = p.project_id AND h.pair = q.pair
GROUP BY p.project_id, q.pair, q."from", q."to\""""


def _returns(cohort: str, back: str, where: str = "TRUE") -> str:
    return f"""{EVENTS},
cohorts AS (
  SELECT project_id, user_id, CAST(date_trunc('week', ts) AS DATE) AS cohort_week
  FROM analytics_events WHERE event = '{cohort}' AND {where} GROUP BY 1, 2, 3
),
returns AS (
  SELECT DISTINCT c.project_id, c.user_id, c.cohort_week,
    CAST(date_trunc('week', e.ts) AS DATE) AS return_week
  FROM cohorts c JOIN analytics_events e
    ON e.project_id = c.project_id AND e.user_id = c.user_id AND e.event = '{back}'
),
cells AS (
  SELECT project_id, cohort_week, return_week, CAST(count(DISTINCT user_id) AS BIGINT) AS users
  FROM returns WHERE return_week >= cohort_week GROUP BY 1, 2, 3
)"""


def _retention(periods: int) -> str:
    cells = ", ".join(
        f"coalesce(max(users) FILTER (WHERE return_week - cohort_week = {7 * p}), 0) AS period_{p}"
        for p in range(periods)
    )
    return f"""
SELECT project_id, CAST(cohort_week AS VARCHAR) AS cohort,
  coalesce(max(users) FILTER (WHERE return_week = cohort_week), 0) AS total, {cells}
FROM cells GROUP BY project_id, cohort_week"""


def _quota(limit: int, span: int) -> str:
    return f"""
SELECT event_id, {span} AS window_seconds, quota_key, rn <= {limit} AS allowed,
  CAST(greatest({limit} - rn, 0) AS BIGINT) AS remaining
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY quota_key, floor(epoch(arrival_ts) / {span}) ORDER BY arrival_ts, event_id) AS rn
  FROM hashed
)"""


def _client_ip(edge: bool) -> str:
    keep_ip = "CASE WHEN event_id % 3 = 0 THEN '192.0.2.1' END"
    own = "CASE WHEN event_id % 3 = 1 THEN '192.0.2.2' END"
    header = "CASE WHEN event_id % 4 <> 0 THEN '10.0.0.' || CAST(event_id % 250 AS VARCHAR) END"
    if edge:
        client = f"coalesce({header}, {own})"
    else:
        client = f"CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN {own} ELSE {header} END"
    return f"""SELECT event_id, {keep_ip} AS ip, {client} AS client_ip,
  CASE event_id % 3 WHEN 0 THEN '1' WHEN 2 THEN json_extract_string(props, '$.k') END AS k
FROM events"""


def _invalid(expected: str, received: str, path: str) -> str:
    return f"{path}:Invalid input: expected {expected}, received {received}"


_ENVELOPE_ISSUES = f"""CASE
  WHEN doc IS NULL THEN '{_invalid("object", "undefined", "")}'
  WHEN json_type(doc) = 'NULL' THEN '{_invalid("object", "null", "")}'
  WHEN json_type(doc) = 'ARRAY' THEN '{_invalid("object", "array", "")}'
  WHEN json_type(doc, '$.event') IS NULL THEN '{_invalid("string", "undefined", "event")}'
  WHEN json_type(doc, '$.event') <> 'VARCHAR' THEN '{_invalid("string", "number", "event")}'
  WHEN json_type(doc, '$.properties') = 'ARRAY'
    THEN '{_invalid("record", "array", "properties")}'
  WHEN json_type(doc, '$.timestamp') = 'VARCHAR'
    THEN '{_invalid("number", "string", "timestamp")}'
  WHEN json_type(doc, '$.userId') = 'NULL' THEN '{_invalid("string", "null", "userId")}'
  ELSE '' END"""

_RULE_ERRORS = """CASE event
  WHEN 'purchase' THEN 'Missing required property: coupon'
  WHEN 'error' THEN 'Field k should be a string'
  WHEN 'click' THEN 'Missing required property: page|Field k should be a boolean'
  ELSE '' END"""

_SESSIONS = f"""WITH RECURSIVE {EVENTS},{
    _anchors("analytics_events", "project_id, user_id", "ts", "1800 SECOND")
},
held AS (
  SELECT e.event_id, e.project_id, e.user_id, max(a.anchor) AS anchor FROM analytics_events e
  JOIN anchors a ON a.project_id = e.project_id AND a.user_id = e.user_id AND a.anchor <= e.ts
  GROUP BY 1, 2, 3
)
SELECT event_id, CASE WHEN user_id <> '' THEN
  sha256(project_id || '|' || user_id || '|' || CAST(epoch_us(anchor) AS VARCHAR)) END
  AS session_id FROM held"""

_OVERLAP = f"""WITH {TRACKED}
SELECT event_id, CASE WHEN third < 192 THEN n_name ELSE 'ANY' END AS country,
  CASE WHEN third BETWEEN 64 AND 127 THEN 'inner' WHEN third < 192
    THEN 'city_' || CAST(nation AS VARCHAR) ELSE 'outer' END AS city
FROM tracked JOIN nation ON n_nationkey = nation"""

_RETRIED_STATE = """
after AS (
  SELECT id,
    CASE WHEN status <> 'pending' THEN status
      WHEN original_topic = 'enriched-events' THEN 'pending' ELSE 'retried' END AS status,
    CASE WHEN status = 'pending' AND original_topic = 'raw-events' THEN retry_count + 1
      ELSE retry_count END AS retry_count,
    CASE WHEN status = 'pending' AND original_topic = 'enriched-events' THEN 'broker down'
      ELSE last_error END AS last_error
  FROM states
)"""


def _held(ttl: str) -> str:
    return f"""WITH RECURSIVE {EVENTS},{
        _anchors("analytics_events", "project_id, user_id", "ts", ttl)
    }
SELECT e.event_id, max(a.anchor) AS anchor FROM analytics_events e JOIN anchors a
  ON a.project_id = e.project_id AND a.user_id = e.user_id AND a.anchor <= e.ts
GROUP BY e.event_id"""


# Three batches: on-time events of ten days each, late ones in the last. The clock is the
# latest arrival; a minute closes when it lies two minutes behind.
CLOSING = f"""{EVENTS},
dealt AS (
  SELECT project_id, event, date_trunc('minute', ts) AS bucket, ts,
    CASE WHEN event_id % 5 = 0 OR day(ts) > 20 THEN 2 WHEN day(ts) > 10 THEN 1 ELSE 0 END AS batch
  FROM analytics_events
),
steps AS (
  SELECT batch, date_trunc('minute', max(max(ts)) OVER (ORDER BY batch)) - INTERVAL 2 MINUTE AS until
  FROM dealt GROUP BY batch
),
placed AS (
  SELECT d.project_id, d.event, d.bucket, d.batch,
    (SELECT min(s.batch) FROM steps s WHERE s.until >= d.bucket) AS closes
  FROM dealt d
),
log AS (
  SELECT project_id, event, bucket, CASE WHEN batch <= closes THEN 'close' ELSE 'correction' END AS kind,
    CAST(count(*) AS BIGINT) AS count, CAST(greatest(batch, closes) AS BIGINT) AS batch
  FROM placed WHERE closes IS NOT NULL
  GROUP BY project_id, event, bucket, kind, greatest(batch, closes)
)"""

ORACLES: dict[str, str] = {
    # --- scans
    "scan_events_range": f"""WITH {EVENTS}
SELECT event_id, project_id, event, user_id, ts FROM analytics_events
WHERE event IN ('view', 'click') AND ts BETWEEN {FROM} AND {TO}""",
    "scan_rollups_range": f"""WITH {ROLLUPS}
SELECT project_id, event, bucket, count FROM rollups
WHERE event = 'view' AND bucket BETWEEN {FROM} AND {TO}""",
    "write_events": f"""WITH {EVENTS}
SELECT event_id, project_id, event, user_id, ts FROM analytics_events""",
    "layout_events": f"""WITH {EVENTS}
SELECT project_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS events
FROM analytics_events WHERE ts BETWEEN {FROM} AND {TO} GROUP BY 1, 2""",
    "expire_events": """SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-04-15 07:30:00' - INTERVAL 90 DAY""",
    "write_topic": f"""WITH {EVENTS}
SELECT project_id AS key, CAST(event_id AS VARCHAR) AS event_id, event, user_id, properties
FROM analytics_events""",
    # --- rollups
    "rolling_counts": "WITH "
    + EVENTS
    + "\n"
    + "\nUNION ALL\n".join(
        f"""SELECT project_id, event, '{g}' AS grain, date_trunc('{g}', ts)::TIMESTAMP AS bucket,
  CAST(count(*) AS BIGINT) AS count FROM analytics_events GROUP BY 1, 2, 3, 4"""
        for g in ("minute", "hour", "day")
    ),
    "daily_uniques": f"""WITH {EVENTS}
SELECT project_id, event, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users
FROM analytics_events WHERE user_id <> '' GROUP BY 1, 2, 3""",
    "build_rollups": f"WITH {ROLLUPS} SELECT * FROM rollups",
    "upsert_rollups": f"""WITH {EVENTS},
days AS (
  SELECT device_type, project_id, event, CAST(ts AS DATE) AS day,
    count(DISTINCT user_id) FILTER (WHERE user_id <> '') AS uniques
  FROM analytics_events GROUP BY 1, 2, 3, 4
)
SELECT a.project_id, a.event, date_trunc('minute', a.ts) AS bucket,
  CAST(count(*) AS BIGINT) AS count, CAST(max(d.uniques) AS BIGINT) AS unique_users
FROM analytics_events a JOIN days d ON d.device_type = a.device_type
  AND d.project_id = a.project_id AND d.event = a.event AND d.day = CAST(a.ts AS DATE)
GROUP BY 1, 2, 3""",
    "publish_live": f"""WITH {ROLLUPS}
SELECT project_id, 'metric_update' AS type, project_id AS message_project, event,
  count AS count_1m, unique_users AS active_users, epoch_ms(bucket) AS bucket_ms FROM rollups""",
    "live_counts": f"""WITH {EVENTS}
SELECT project_id, event, CAST(count(*) AS BIGINT) AS count FROM analytics_events
WHERE date_trunc('minute', ts) = (SELECT date_trunc('minute', max(ts)) FROM events)
GROUP BY 1, 2""",
    "hll_uniques": f"""WITH {EVENTS}
SELECT project_id, CAST(count(DISTINCT user_id) AS BIGINT) AS users, TRUE AS close
FROM analytics_events WHERE user_id <> '' GROUP BY 1""",
    "hll_uniques_error": f"""WITH {EVENTS}
SELECT project_id, event, CAST(count(DISTINCT user_id) AS BIGINT) AS users, TRUE AS close
FROM analytics_events WHERE user_id <> '' GROUP BY 1, 2""",
    # --- analytical queries
    "metrics_minute": _metrics("minute"),
    "metrics_hour": _metrics("hour"),
    "metrics_day": _metrics("day"),
    "metrics_grains": _metrics(
        "day", "bucket BETWEEN TIMESTAMP '2024-01-05 07:13:20' AND TIMESTAMP '2024-01-25 18:42:59'"
    ),
    "metrics_project_event": _metrics(
        "hour",
        f"project_id = 'proj_1' AND event = 'view' AND bucket BETWEEN {FROM} AND {TO}",
        keys="",
    ),
    "metrics_unique_exact": f"""WITH {EVENTS}
SELECT project_id, event, date_trunc('day', ts)::TIMESTAMP AS bucket,
  CAST(count(*) AS BIGINT) AS count,
  CAST(count(DISTINCT user_id) FILTER (WHERE user_id <> '') AS BIGINT) AS unique_users
FROM analytics_events GROUP BY 1, 2, 3""",
    "metrics_unique": f"""WITH {EVENTS}
SELECT project_id, event, date_trunc('day', ts)::TIMESTAMP AS bucket,
  CAST(count(*) AS BIGINT) AS count,
  CAST(count(DISTINCT user_id) FILTER (WHERE user_id <> '') AS BIGINT) AS users, TRUE AS close
FROM analytics_events GROUP BY 1, 2, 3""",
    "funnel_1h": _funnel(("view", "click", "purchase"), "1 HOUR"),
    "funnel_1d": _funnel(("view", "click", "purchase"), "1 DAY"),
    "funnel_same_event": _funnel(("view", "view", "signup", "view"), "7 DAY"),
    "funnel_from_to": _funnel(
        ("view", "click", "purchase"), "2 HOUR", f"(ts >= {FROM} AND ts <= {TO})"
    ),
    "funnel_project": _funnel(("view", "click", "purchase"), "30 MINUTE", project="proj_2"),
    "retention": f"WITH {_returns('signup', 'purchase')}{_retention(8)}",
    "retention_with_size": f"""WITH {
        _returns('signup', 'purchase', f'ts BETWEEN {FROM} AND {TO}')
    },
sizes AS (SELECT project_id, CAST(cohort_week AS VARCHAR) AS cohort, CAST(count(*) AS BIGINT) AS cohort_size
  FROM cohorts GROUP BY 1, 2)
SELECT r.*, s.cohort_size FROM ({_retention(4)}) r JOIN sizes s USING (project_id, cohort)""",
    "retention_long": f"""WITH {_returns('view', 'view')}
SELECT project_id, CAST(cohort_week AS VARCHAR) AS cohort_week,
  CAST(return_week AS VARCHAR) AS return_week, users FROM cells""",
    "user_profiles": f"""WITH {EVENTS}
SELECT project_id, user_id, country, city, browser, os, device_type,
  min(ts) AS first_seen, max(ts) AS last_seen
FROM analytics_events WHERE user_id <> '' GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "users_page": f"""WITH {EVENTS}
SELECT project_id, user_id, country, city, browser, os, device_type,
  min(ts) AS first_seen, max(ts) AS last_seen
FROM analytics_events WHERE user_id <> '' GROUP BY 1, 2, 3, 4, 5, 6, 7
ORDER BY last_seen DESC, 1, 2, 3, 4, 5, 6, 7 LIMIT 100 OFFSET 20""",
    "users_filtered": f"""WITH {EVENTS}
SELECT project_id, user_id, country, city, browser, os, device_type,
  min(ts) AS first_seen, max(ts) AS last_seen
FROM analytics_events WHERE user_id <> '' AND browser = 'Firefox' GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "parse_window": """SELECT event_id, CAST(CASE
    WHEN event_id % 13 = 0 OR event_id % 5 = 4 THEN 604800
    ELSE (event_id % 13) * CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600
      ELSE 86400 END END AS BIGINT) AS seconds FROM events""",
    "tenant_scope": f"""WITH {EVENTS},{PROJECTS}
SELECT project_id, CAST(count(*) AS BIGINT) AS events FROM analytics_events
WHERE project_id IN (SELECT project_id FROM projects WHERE org_id = 'org_1') GROUP BY 1""",
    # --- ingest
    "attach_project": f"""WITH {KEYS}
SELECT r.event_id, k.project_id, p.org_id FROM requests r
JOIN api_keys k ON k.api_key = r.api_key AND (k.expires_at IS NULL OR k.expires_at > r.arrival_ts)
JOIN projects p ON p.project_id = k.project_id""",
    "reject_keys": f"""WITH {KEYS}
SELECT r.event_id, r.api_key FROM requests r WHERE NOT EXISTS (
  SELECT 1 FROM api_keys k WHERE k.api_key = r.api_key
    AND (k.expires_at IS NULL OR k.expires_at > r.arrival_ts))""",
    "rate_limit": f"""WITH {REQUESTS},
hashed AS (SELECT *, substr(sha256(api_key), 1, 16) AS quota_key FROM requests)
{_quota(3, 3600)} UNION ALL {_quota(40, 86400)}""",
    "rate_limit_large": f"""WITH {REQUESTS},
hashed AS (SELECT *, substr(sha256(api_key), 1, 16) AS quota_key FROM requests)
{_quota(1500, 2592000)}""",
    "explode_batch": f"""WITH {BODIES},
items AS (
  SELECT event_id, 0 AS pos, doc AS item FROM docs WHERE doc IS NULL OR json_type(doc) <> 'ARRAY'
  UNION ALL
  SELECT event_id, unnest(range(CAST(json_array_length(doc) AS BIGINT))) AS pos,
    unnest(json_extract(doc, '$[*]')) AS item FROM docs WHERE json_type(doc) = 'ARRAY'
)
SELECT event_id, CAST(pos AS INTEGER) AS pos,
  CASE WHEN item IS NULL THEN 'undefined' ELSE CASE json_type(item) WHEN 'OBJECT' THEN 'object'
    WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind,
  json_extract_string(item, '$.projectId') AS project_id FROM items""",
    "inject_client_ip": _client_ip(edge=False),
    "inject_client_ip_edge": _client_ip(edge=True),
    "assign_trace_id": f"""WITH {ARRIVALS}
SELECT event_id, seq, sha256(CAST(event_id AS VARCHAR) || '|' || CAST(seq AS VARCHAR)) AS trace_id
FROM arrivals""",
    "dedup_key": f"WITH {ARRIVALS} SELECT event_id, seq, dedup_key FROM keyed",
    "dedup_events": f"""WITH RECURSIVE {ARRIVALS},{
        _anchors("keyed", "dedup_key", "arrival_ts", "60 SECOND")
    }
SELECT k.event_id, k.seq, CASE WHEN a.anchor IS NULL THEN 'duplicate' ELSE 'accepted' END AS status
FROM keyed k LEFT JOIN anchors a ON a.dedup_key = k.dedup_key AND a.anchor = k.arrival_ts""",
    "ingest_status": f"""WITH {BODIES}
SELECT status, CAST(count(*) AS BIGINT) AS items FROM (
  SELECT CASE WHEN c = 7 THEN 'error' WHEN c IN (1, 2, 3, 4, 5, 6) THEN 'rejected'
    ELSE 'accepted' END AS status FROM bodies
  UNION ALL SELECT 'rejected' FROM bodies WHERE c IN (8, 9)
) GROUP BY 1""",
    # --- validation
    "parse_event": f"""WITH {BODIES}
SELECT event_id, doc IS NULL OR json_type(doc) = 'NULL' AS is_malformed FROM docs""",
    "validate_envelope": f"WITH {BODIES} SELECT event_id, {_ENVELOPE_ISSUES} AS issues FROM docs",
    "strip_unknown": f"""WITH {BODIES}
SELECT event_id,
  CASE WHEN json_type(doc, '$.event') = 'VARCHAR' THEN json_extract_string(doc, '$.event') END
    AS event,
  json_extract_string(doc, '$.projectId') AS project_id,
  CAST(TRY_CAST(json_extract_string(doc, '$.timestamp') AS BIGINT) AS VARCHAR) AS ts_ms,
  json_extract_string(doc, '$.userId') AS user_id FROM docs""",
    "validate_properties": f"""WITH {EVENTS}
SELECT event_id, {_RULE_ERRORS} AS errors FROM analytics_events""",
    "upsert_schema": f"""WITH {EVENTS},
changes AS (
  SELECT *, '{{"required":["f' || CAST(event_id AS VARCHAR) || '"]}}' AS schema,
    row_number() OVER (PARTITION BY project_id, event ORDER BY event_id) AS version,
    min(ts) OVER (PARTITION BY project_id, event) AS created_at
  FROM analytics_events
)
SELECT project_id, event, schema, CAST(version AS BIGINT) AS version, created_at, ts AS updated_at
FROM changes c WHERE version = (
  SELECT count(*) FROM analytics_events a WHERE a.project_id = c.project_id AND a.event = c.event)
""",
    "read_schema_registry": f"""WITH {PROJECTS}
SELECT project_id, event, schema FROM projects, (VALUES
  ('purchase', '{{"required":["k","coupon"],"properties":{{"k":{{"type":"number"}}}}}}'),
  ('error', '{{"required":["k"],"properties":{{"k":{{"type":"string"}}}}}}'),
  ('signup', '{{"properties":{{"k":{{"type":"number"}},"z":{{"type":"boolean"}}}}}}'),
  ('click', '{{"required":["page"],"properties":{{"page":{{"type":"string"}},"k":{{"type":"boolean"}}}}}}')
) AS r(event, schema)""",
    "read_geo_ranges": """SELECT CAST(10 * 16777216 + n_nationkey * 65536 AS BIGINT) AS start_ip,
  CAST(10 * 16777216 + n_nationkey * 65536 + 49151 AS BIGINT) AS end_ip, n_name AS country,
  'city_' || CAST(n_nationkey AS VARCHAR) AS city FROM nation""",
    "route_valid_rejected": f"""WITH {BODIES}
SELECT event_id, CASE WHEN c IN (6, 7) THEN 'Malformed message'
  WHEN c IN (1, 2, 3, 4, 5, 8, 9) THEN 'Schema validation failed'
  WHEN event IN ('purchase', 'error', 'click') THEN 'Project schema validation failed'
  ELSE 'valid' END AS route FROM bodies""",
    # --- enrichment
    "extract_context": f"WITH {TRACKED} SELECT event_id, address, agent FROM tracked",
    "geo_enrich": f"WITH {TRACKED} SELECT event_id, country, city FROM located",
    "geo_enrich_many_ranges": f"WITH {TRACKED} SELECT event_id, country, city FROM located",
    "geo_enrich_ipv6": """
SELECT e.event_id,
  CASE WHEN e.event_id % 8 = 7 THEN NULL WHEN e.event_id % 8 = 6 THEN 'ANY'
    WHEN e.event_id % 8 <= 2 OR e.event_id % 256 < 192 THEN n.n_name END AS country,
  CASE WHEN e.event_id % 8 = 7 THEN NULL WHEN e.event_id % 8 = 6 THEN 'outer'
    WHEN e.event_id % 8 = 1 THEN 'inner'
    WHEN e.event_id % 8 <= 2 OR e.event_id % 256 < 192
      THEN 'city_' || CAST(n.n_nationkey AS VARCHAR) END AS city
FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "geo_enrich_overlap": _OVERLAP,
    "geo_enrich_overlap_many": _OVERLAP,
    "ua_enrich": f"""WITH {TRACKED}
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Mobile Safari' WHEN 2 THEN 'Firefox'
    WHEN 3 THEN 'Mobile Chrome' WHEN 4 THEN 'Safari' ELSE 'unknown' END AS browser,
  CASE event_id % 6 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Ubuntu'
    WHEN 3 THEN 'Android' WHEN 4 THEN 'macOS' ELSE 'unknown' END AS os,
  CASE event_id % 6 WHEN 1 THEN 'mobile' WHEN 3 THEN 'mobile' WHEN 5 THEN 'unknown'
    ELSE 'desktop' END AS device_type
FROM tracked""",
    "fixed_ttl_anchor": _held("6 HOUR"),
    "fixed_ttl_anchor_tree": _held("2 DAY"),
    "sessionize": _SESSIONS,
    "enrich_project": f"""WITH RECURSIVE {TRACKED},{
        _anchors("tracked", "project_id, user_id", "ts", "1800 SECOND")
    },
held AS (
  SELECT e.event_id, max(a.anchor) AS anchor FROM tracked e
  JOIN anchors a ON a.project_id = e.project_id AND a.user_id = e.user_id AND a.anchor <= e.ts
  GROUP BY 1
)
SELECT l.event_id, l.country, l.city,
  CASE event_id % 6 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Mobile Safari' WHEN 2 THEN 'Firefox'
    WHEN 3 THEN 'Mobile Chrome' WHEN 4 THEN 'Safari' ELSE 'unknown' END AS browser,
  CASE event_id % 6 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Ubuntu'
    WHEN 3 THEN 'Android' WHEN 4 THEN 'macOS' ELSE 'unknown' END AS os,
  CASE event_id % 6 WHEN 1 THEN 'mobile' WHEN 3 THEN 'mobile' WHEN 5 THEN 'unknown'
    ELSE 'desktop' END AS device_type,
  sha256(project_id || '|' || user_id || '|' || CAST(epoch_us(anchor) AS VARCHAR)) AS session_id
FROM located l JOIN held USING (event_id)""",
    "normalise_event_row": f"""WITH {EVENTS}
SELECT event_id, project_id, event, user_id,
  CASE WHEN event_id % 3 = 0 THEN sha256(CAST(event_id AS VARCHAR)) ELSE '' END AS session_id,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE country END AS country, city, device_type, browser, os,
  CASE WHEN event_id % 3 = 0 THEN '{{}}' ELSE properties END AS properties,
  date_trunc('milliseconds', ts) AS ts
FROM analytics_events""",
    # --- dead letters
    "dlq_envelope": f"""WITH {LETTERS}
SELECT original_key AS key, original_topic AS header_topic,
  substr(repeat(reason || ';', 30), 1, 500) AS header_reason, original_topic AS topic,
  original_partition AS partition, original_offset AS offset, original_value,
  CAST(id AS VARCHAR) AS trace_id, CAST(30 * (length(reason) + 1) AS BIGINT) AS reason_length,
  CAST(floor(epoch_us(created_at) / 1000) AS BIGINT) AS at_ms FROM letters""",
    "dlq_store": f"""WITH {LETTERS}
SELECT original_topic || '/' || CAST(original_partition AS VARCHAR) || '/' || original_offset AS id,
  original_topic, original_partition, original_key, reason, 'pending' AS status
FROM letters WHERE id % 10 <> 0""",
    "dlq_current": f"""WITH {LETTERS}
SELECT id, status, retry_count, last_error, updated_at FROM states""",
    "dlq_list": f"""WITH {LETTERS}
SELECT id, original_topic, original_partition, original_offset, original_key, reason, status,
  retry_count, created_at, updated_at
FROM states WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 10""",
    "dlq_total": f"""WITH {LETTERS}
SELECT CAST(count(*) AS BIGINT) AS total FROM states WHERE status = 'pending'""",
    "dlq_get": f"""WITH {LETTERS}
SELECT id, original_topic, original_offset, original_value, reason, status, retry_count, last_error,
  created_at, updated_at FROM states WHERE id = (SELECT max(id) FROM letters)""",
    "dlq_retry": f"WITH {LETTERS},{_RETRIED_STATE} SELECT * FROM after",
    "dlq_retry_messages": f"""WITH {LETTERS}
SELECT id, original_topic AS topic, original_key AS key, original_value AS value,
  CAST(id AS VARCHAR) AS trace_id FROM states WHERE status = 'pending'""",
    "dlq_discard": f"""WITH {LETTERS}
SELECT id, CASE WHEN status = 'pending' AND original_topic = 'raw-events' THEN 'discarded'
    ELSE status END AS status,
  CASE WHEN status = 'pending' AND original_topic = 'raw-events'
    THEN TIMESTAMP '2024-01-15 12:00:30' ELSE updated_at END AS updated_at FROM states""",
    "dlq_reasons": f"""WITH {LETTERS}
SELECT split_part(reason, ':', 1) AS reason_class, original_topic, status,
  CAST(count(*) AS BIGINT) AS letters FROM states GROUP BY 1, 2, 3""",
    # --- health
    "stage_counts": f"WITH {STAGES} SELECT stage, bucket, n AS count FROM counted",
    "stage_rates": f"""WITH {STAGES}
SELECT c.stage, c.bucket, round(CAST(sum(p.n) AS DOUBLE) / 300, 6) AS per_second
FROM counted c JOIN counted p ON p.stage = c.stage AND p.bucket <= c.bucket
  AND p.bucket > c.bucket - INTERVAL 300 SECOND
GROUP BY 1, 2""",
    "lag_histogram": f"WITH {HISTOGRAM} SELECT * FROM histogram",
    "lag_p99": f"""WITH {HISTOGRAM},
ranked AS (
  SELECT *, max(cumulative_count) OVER (PARTITION BY stage) * 0.99::DOUBLE AS wanted,
    lag(cumulative_count, 1, 0) OVER (PARTITION BY stage ORDER BY le) AS low_count,
    lag(le, 1, 0.0::DOUBLE) OVER (PARTITION BY stage ORDER BY le) AS low_le
  FROM histogram
),
hit AS (
  SELECT *, row_number() OVER (PARTITION BY stage ORDER BY le) AS rn FROM ranked
  WHERE cumulative_count >= wanted
)
SELECT stage, round(CASE WHEN isinf(le) THEN low_le
  ELSE low_le + (le - low_le) * (wanted - low_count) / (cumulative_count - low_count) END, 6)
  AS value FROM hit WHERE rn = 1""",
    # --- streams
    "stream_dedup": f"""WITH RECURSIVE {ARRIVALS},{
        _anchors("keyed", "dedup_key", "arrival_ts", "60 SECOND")
    }
SELECT k.event_id, k.seq FROM keyed k
JOIN anchors a ON a.dedup_key = k.dedup_key AND a.anchor = k.arrival_ts""",
    "stream_sessions": _SESSIONS,
    "stream_quota": f"""WITH {REQUESTS},
hashed AS (SELECT *, substr(sha256(api_key), 1, 16) AS quota_key FROM requests)
SELECT event_id, quota_key, allowed, remaining FROM ({_quota(40, 86400)})""",
    "stream_rollups": f"WITH {ROLLUPS} SELECT project_id, event, bucket, count FROM rollups",
    "stream_ingest": f"""WITH {BODIES}
SELECT project_id, event, user_id, CAST(ms AS BIGINT) AS ms FROM bodies WHERE c NOT BETWEEN 1 AND 7""",
    "stream_enrichment": f"""WITH RECURSIVE {BODIES},
outcomes AS (
  SELECT event_id, arrival_ts, project_id, user_id,
    CASE WHEN c IN (6, 7) THEN 'Malformed message'
      WHEN c IN (1, 2, 3, 4, 5, 8, 9) THEN 'Schema validation failed'
      WHEN event IN ('purchase', 'error', 'click') THEN 'Project schema validation failed'
      ELSE event END AS outcome FROM bodies
),
valid AS (SELECT * FROM outcomes WHERE outcome NOT LIKE '% %' AND user_id <> ''),{
        _anchors("valid", "project_id, user_id", "arrival_ts", "1800 SECOND")
    },
held AS (
  SELECT v.event_id, max(a.anchor) AS anchor FROM valid v
  JOIN anchors a ON a.project_id = v.project_id AND a.user_id = v.user_id AND a.anchor <= v.arrival_ts
  GROUP BY 1
)
SELECT o.event_id, outcome, sha256(project_id || '|' || user_id || '|'
    || CAST(epoch_us(anchor) AS VARCHAR)) AS session_id,
  CASE WHEN outcome NOT LIKE '% %' THEN 't' || CAST(o.event_id AS VARCHAR) END AS trace_id
FROM outcomes o LEFT JOIN held h ON h.event_id = o.event_id""",
    "stream_storage": f"""WITH {EVENTS}
SELECT project_id, event, user_id, country, city, device_type, browser, os,
  CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM analytics_events""",
    "stream_replayed_topic": f"""WITH {EVENTS}
SELECT project_id, event, user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM analytics_events""",
    "stream_live_feed": f"""WITH {EVENTS}
SELECT project_id, event, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  CAST(count(*) AS BIGINT) AS events,
  CAST(count(DISTINCT user_id) FILTER (WHERE user_id <> '') AS BIGINT) AS users
FROM analytics_events GROUP BY 1, 2, 3""",
    "stream_daily_uniques": f"""WITH {EVENTS},
updates AS (
  SELECT project_id, event, CAST(ts AS DATE) AS day, user_id, ts + CASE WHEN event_id % 7 = 0
    THEN INTERVAL 12 DAY WHEN event_id % 5 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS came
  FROM analytics_events WHERE user_id <> ''
),
gaps AS (
  SELECT *, lag(came) OVER (PARTITION BY project_id, event, day ORDER BY came) AS before FROM updates
),
runs AS (
  SELECT *, max(CASE WHEN came >= before + INTERVAL 7 DAY THEN came END) OVER own AS start,
    max(came) OVER own AS last
  FROM gaps WINDOW own AS (PARTITION BY project_id, event, day)
)
SELECT project_id, event, CAST(day AS VARCHAR) AS day, CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users
FROM runs WHERE (start IS NULL OR came >= start) AND last + INTERVAL 7 DAY > TIMESTAMP '2024-02-02 00:00:00'
GROUP BY 1, 2, 3""",
    "stream_closing_log": f"WITH {CLOSING} SELECT * FROM log",
    "stream_closed_rollups": f"""WITH {CLOSING}
SELECT project_id, event, bucket, CAST(sum(count) AS BIGINT) AS count,
  CAST(count(*) FILTER (WHERE kind = 'correction') AS BIGINT) AS corrections
FROM log GROUP BY project_id, event, bucket""",
    "stream_dead_letters": f"""WITH {LETTERS}
SELECT original_topic || '/' || CAST(original_partition AS VARCHAR) || '/' || original_offset AS id,
  original_topic, original_partition, original_key, reason, 'pending' AS status FROM letters""",
}
# The same rows by another way.
ORACLES["retention_bitmaps"] = ORACLES["retention"]
ORACLES["retention_bitmaps_range"] = ORACLES["retention_with_size"]
