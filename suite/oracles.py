"""Expected results as SQL over the generated tables.

The expectations follow from the arithmetic that built the inputs; no text the
library produced is read back.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def uuid(text: str) -> str:
    return (
        f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$',"
        r" '\1-\2-\3-\4-\5')"
    )


ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"

CANONICAL = f"""
c AS (
  SELECT
    e.event_id AS n,
    'app' || (e.user_id % 3) AS app_id,
    {uuid("CAST(e.event_id AS VARCHAR)")} AS event_id,
    CASE e.event_type WHEN 'view' THEN 'page' WHEN 'signup' THEN 'identify' ELSE 'track' END
      AS type,
    CASE e.event_type WHEN 'view' THEN 'page.viewed' WHEN 'click' THEN 'button.clicked'
      WHEN 'purchase' THEN 'checkout.completed' WHEN 'error' THEN 'app.error' END AS name,
    e.ts AS occurred_at,
    strftime(e.ts, {ISO}) AS occurred_at_iso,
    ['web', 'ios', 'android', 'server'][e.event_id % 4 + 1] AS platform,
    CASE WHEN e.event_id % 5 <> 0 THEN 'user_' || e.user_id END AS user_id,
    CASE WHEN e.event_id % 5 = 0 OR e.event_id % 3 = 0 THEN 'anon_' || (e.user_id % 50) END
      AS anonymous_id,
    CASE WHEN e.event_id % 11 <> 0
      THEN 'sess_' || e.user_id || '_' || strftime(e.ts, '%Y%m%d') END AS session_id,
    e.ts + to_seconds(2 + e.event_id % 7) AS received_at,
    e.ts + to_seconds(2 + e.event_id % 7) + to_milliseconds(150 * (e.event_id % 13))
      AS processed_at,
    e.value AS value,
    CAST(json_extract(e.props, '$.k') AS INTEGER) AS k,
    e.user_id AS user_no,
    e.event_id // 150 AS w
  FROM events e
)"""

# Batches: one per app and run of 150 source ids, events in id order.
BATCHED = f"""
b AS (
  SELECT c.*, c.app_id || '-' || c.w AS batch_key,
    {uuid("c.app_id || '-' || c.w")} AS batch_id,
    row_number() OVER (PARTITION BY c.app_id, c.w ORDER BY c.n) - 1 AS idx,
    max(c.received_at) OVER (PARTITION BY c.app_id, c.w) AS batch_received,
    CASE WHEN c.n % 1009 % 53 = 0 AND c.n % 1009 // 53 BETWEEN 1 AND 19
      THEN c.n % 1009 // 53 END AS r
  FROM c
)"""

SIZES = """
sizes AS (
  SELECT batch_key, any_value(batch_id) AS batch_id, any_value(app_id) AS app_id,
    any_value(w) AS w, any_value(batch_received) AS received_at, count(*) AS sent,
    count(*) FILTER (n % 200 = 0) AS twice, count(r) AS broken
  FROM b GROUP BY batch_key
)"""

# Both deliveries of every batch.
DELIVERIES = f"""
d AS (
  SELECT batch_key, batch_id, app_id, w, received_at, sent, twice, broken FROM sizes
  UNION ALL
  SELECT batch_key, {uuid("batch_key || '-again'")}, app_id, w,
    received_at + INTERVAL 1 HOUR, sent, twice, broken
  FROM sizes WHERE w % 4 = 0
)"""


def request_of(key: str) -> str:
    return uuid(f"'request:' || {key}")


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BASE = with_(CANONICAL)
BATCHES = with_(CANONICAL, BATCHED, SIZES)
ALL_DELIVERIES = with_(CANONICAL, BATCHED, SIZES, DELIVERIES)


def cursor(app: str = "app_id", iso: str = "occurred_at_iso", event: str = "event_id") -> str:
    text = f"""'{{"pk":"' || {app} || '","sk":"' || {iso} || '#' || {event} || '"}}'"""
    return f"rtrim(replace(replace(to_base64(encode({text})), '+', '-'), '/', '_'), '=')"


# ------------------------------------------------------------------ reads

PAGE_WHERE = ("app_id = 'app1' AND type = 'track' AND occurred_at >= TIMESTAMP '2024-01-05'"
              " AND occurred_at < TIMESTAMP '2024-01-26'")


def page(order: str, skip: int = 0) -> str:
    return f"""{BASE}, numbered AS (
      SELECT *, row_number() OVER (ORDER BY occurred_at {order}, event_id {order}) - {skip} AS pos,
        count(*) OVER () > {skip} + 50 AS has_more
      FROM c WHERE {PAGE_WHERE})
    SELECT pos, event_id, type, name, user_id, session_id, occurred_at_iso, has_more,
      CASE WHEN has_more AND pos = 50 THEN {cursor()} END AS next_cursor
    FROM numbered WHERE pos BETWEEN 1 AND 50"""


SQL["query_page_desc"] = page("DESC")
SQL["query_page_asc"] = page("ASC")
SQL["query_second_page"] = page("DESC", 50)

FILTERED = "event_id, app_id, type, name, user_id, anonymous_id, session_id, occurred_at"


def filtered(where: str) -> str:
    return f"{BASE} SELECT {FILTERED} FROM c WHERE app_id = 'app1' AND {where}"


SQL["filter_app"] = filtered("TRUE")
SQL["filter_types"] = filtered("type IN ('page', 'identify')")
SQL["filter_names"] = filtered("name IN ('button.clicked', 'app.error')")
SQL["filter_user"] = filtered("user_id = 'user_7'")
SQL["filter_anonymous"] = filtered("anonymous_id = 'anon_7'")
SQL["filter_session"] = filtered("session_id = 'sess_7_20240105'")
SQL["filter_all"] = filtered(
    "type = 'track' AND name = 'checkout.completed' AND user_id = 'user_7'"
    " AND occurred_at >= TIMESTAMP '2024-01-03'")
SQL["time_range_half_open"] = f"""{BASE}
  SELECT {FILTERED} FROM c
  WHERE occurred_at >= (SELECT min(ts) FROM events WHERE ts >= TIMESTAMP '2024-01-08')
    AND occurred_at < (SELECT min(ts) FROM events WHERE ts >= TIMESTAMP '2024-01-20')"""

# The parts of each raw request that follow from the source id.
REQUESTS = """
q AS (
  SELECT n, event_id AS request_id, app_id AS app, occurred_at AS ts, user_id,
    n % 37 = 3 AS app_blank, n % 37 = 5 AS app_missing,
    n % 41 = 4 AS from_bad, n % 41 = 6 AS from_missing,
    n % 7 = 2 AS to_missing, n % 33 AS days,
    n % 9 AS t, n % 11 AS m, n % 13 AS u, n % 8 AS l, n % 12 AS s
  FROM c),
z AS (
  SELECT *,
    CASE WHEN to_missing THEN TIMESTAMP '2024-01-31' ELSE ts + to_days(CAST(days AS INTEGER)) END
      AS until,
    app_missing OR from_missing OR t = 2 OR l = 4 OR s = 2 AS stopped
  FROM q),
y AS (
  SELECT *,
    CASE WHEN from_bad OR until <= ts THEN TRUE ELSE FALSE END AS unordered,
    CASE WHEN from_bad OR until > ts + INTERVAL 31 DAY THEN TRUE ELSE FALSE END AS wide
  FROM z),
others AS (
  SELECT request_id, 1 AS o, 'appId' AS path, 'Required' AS message, 'invalid_type' AS code
    FROM y WHERE app_missing
  UNION ALL SELECT request_id, 1, 'appId', 'appId is required', 'too_small' FROM y WHERE app_blank
  UNION ALL SELECT request_id, 2, 'from', 'Required', 'invalid_type' FROM y WHERE from_missing
  UNION ALL SELECT request_id, 2, 'from', 'from must be a valid ISO 8601 datetime',
    'invalid_string' FROM y WHERE from_bad
  UNION ALL SELECT request_id, 4, 'types.1', 'Invalid enum value. Expected ''track'' | ''page'' | '
    || '''identify'', received ''click''', 'invalid_enum_value' FROM y WHERE t = 2
  UNION ALL SELECT request_id, 5, 'types', 'types array must not be empty if provided', 'custom'
    FROM y WHERE t = 1
  UNION ALL SELECT request_id, 6, 'names', 'names array must not be empty if provided', 'custom'
    FROM y WHERE m = 1
  UNION ALL SELECT request_id, 7, 'userId', 'String must contain at least 1 character(s)',
    'too_small' FROM y WHERE u = 1
  UNION ALL SELECT request_id, 8, 'limit', 'limit must be at least 1', 'too_small'
    FROM y WHERE l = 0
  UNION ALL SELECT request_id, 8, 'limit', 'limit must not exceed 200', 'too_big'
    FROM y WHERE l = 3
  UNION ALL SELECT request_id, 8, 'limit', 'Expected number, received string', 'invalid_type'
    FROM y WHERE l = 4
  UNION ALL SELECT request_id, 9, 'sort', 'Invalid enum value. Expected ''asc'' | ''desc'', '
    || 'received ''up''', 'invalid_enum_value' FROM y WHERE s = 2
  UNION ALL SELECT request_id, 10, 'to', 'to must be after from', 'custom'
    FROM y WHERE NOT stopped AND unordered
  UNION ALL SELECT request_id, 11, 'from', 'Date range must not exceed 31 days', 'custom'
    FROM y WHERE NOT stopped AND wide
),
i AS (
  SELECT * FROM others
  UNION ALL SELECT request_id, 12, 'cursor', 'Invalid pagination cursor', 'custom' FROM y
    WHERE n % 17 = 1 AND request_id NOT IN (SELECT request_id FROM others)
)"""

SQL["validate_requests"] = f"""{with_(CANONICAL, REQUESTS)}
  SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY o) - 1 AS issue_index,
    path, message, code FROM i"""
SQL["typed_requests"] = f"""{with_(CANONICAL, REQUESTS)}
  SELECT request_id, app AS app_id, ts AS "start", until AS "end",
    CASE t WHEN 0 THEN 'track|page' WHEN 3 THEN 'identify' END AS types,
    CASE m WHEN 0 THEN 'page.viewed|app.error' END AS names,
    CASE WHEN u < 4 THEN user_id END AS user_id,
    CASE l WHEN 1 THEN 1 WHEN 2 THEN 200 WHEN 5 THEN 25 WHEN 6 THEN 7 ELSE 50 END AS "limit",
    CASE s WHEN 1 THEN 'asc' ELSE 'desc' END AS sort
  FROM y WHERE request_id NOT IN (SELECT request_id FROM i)"""

MANY = f"""{BASE},
r AS (
  SELECT app_id || '-' || user_no AS request_id, app_id, user_no AS u,
    TIMESTAMP '2024-01-02' + to_days(CAST(user_no % 7 AS INTEGER)) + to_hours(user_no % 5) AS f,
    TIMESTAMP '2024-01-02' + to_days(CAST(user_no % 7 AS INTEGER)) + to_hours(user_no % 5)
      + to_days(CAST(user_no % 20 + 1 AS INTEGER)) AS t,
    user_no % 20 + 5 AS lim, user_no % 3 = 0 AS up,
    CASE WHEN user_no // 3 % 3 = 1 THEN TIMESTAMP '2024-01-02'
      + to_days(CAST(user_no % 7 AS INTEGER)) + to_hours(user_no % 5)
      + to_days(CAST(user_no % 9 AS INTEGER)) END AS after
  FROM (SELECT DISTINCT app_id, user_no FROM c)),
hits AS (
  SELECT r.*, c.event_id, c.occurred_at_iso,
    row_number() OVER (PARTITION BY r.request_id ORDER BY
      CASE WHEN up THEN epoch_us(occurred_at) ELSE -epoch_us(occurred_at) END) AS pos,
    count(*) OVER (PARTITION BY r.request_id) AS matches
  FROM r JOIN c ON c.app_id = r.app_id AND c.occurred_at >= r.f AND c.occurred_at < r.t
    AND (after IS NULL OR CASE WHEN up
      THEN c.occurred_at > after OR c.occurred_at = after AND c.event_id > '8'
      ELSE c.occurred_at < after OR c.occurred_at = after AND c.event_id < '8' END)
    AND (u % 8 <> 3 OR c.type IN ('track', 'page'))
    AND (u % 8 <> 7 OR c.name = 'app.error')
    AND (u % 4 <> 0 OR c.user_id = 'user_' || u)
    AND ((u % 4 <> 1 AND u % 16 <> 0) OR c.anonymous_id = 'anon_' || (u % 50))
    AND (u % 4 <> 2 OR c.session_id = 'sess_' || u || '_20240110'))
SELECT request_id, pos, event_id, matches > lim AS has_more,
  CASE WHEN matches > lim AND pos = lim THEN {cursor()} END AS next_cursor
FROM hits WHERE pos <= lim"""
SQL["query_many"] = MANY
SQL["query_many_shuffled"] = MANY

WALK = """w AS (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY occurred_at DESC, event_id DESC) - 1
    AS rn, count(*) OVER (PARTITION BY app_id) AS total FROM c)"""
SQL["page_walk"] = f"""{BASE}, {WALK}
  SELECT app_id, rn // 50 AS page, rn % 50 + 1 AS pos, event_id FROM w"""
SQL["page_index"] = f"""{BASE}, {WALK},
  p AS (SELECT app_id, rn // 50 AS page, count(*) AS items, any_value(total) AS total,
      max_by({cursor()}, rn) AS closing FROM w GROUP BY app_id, rn // 50)
  SELECT app_id, page, items,
    lag(closing) OVER (PARTITION BY app_id ORDER BY page) AS start_cursor,
    (page + 1) * 50 < total AS has_more,
    CASE WHEN (page + 1) * 50 < total THEN closing END AS next_cursor FROM p"""

SQL["query_many_ids"] = f"""{BASE}, g AS (
  SELECT app_id || '/' || user_id || '/' || session_id AS request_id, event_id,
    row_number() OVER (PARTITION BY app_id, user_id, session_id ORDER BY occurred_at DESC, event_id DESC) AS pos,
    count(*) OVER (PARTITION BY app_id, user_id, session_id) AS n
  FROM c WHERE user_id IS NOT NULL AND session_id IS NOT NULL)
  SELECT request_id, CAST(pos AS INTEGER) AS pos, event_id, n > 2 AS has_more FROM g WHERE pos <= 2"""
SQL["page_lookup"] = f"""{BASE}, {WALK}
  SELECT app_id, rn // 25 AS page, CAST(rn % 25 + 1 AS INTEGER) AS pos, event_id FROM w WHERE rn // 25 IN (0, 3)"""

SQL["with_cursor"] = f"{BASE} SELECT event_id, {cursor()} AS cursor FROM c"
SQL["decode_cursors"] = f"""{BASE}
  SELECT n AS row_no, n % 6 IN (0, 1, 4) AS valid,
    CASE WHEN n % 6 IN (0, 1, 4) THEN app_id END AS app_id,
    CASE WHEN n % 6 IN (0, 1) THEN occurred_at END AS occurred_at,
    CASE WHEN n % 6 IN (0, 1) THEN event_id END AS event_id FROM c"""

# ------------------------------------------------------------------ shapes

SQL["api_projection"] = f"""{BASE}
  SELECT '1.0.0' AS schema_version, event_id, type, occurred_at_iso, received_at, app_id,
    platform, 'prod' AS env, user_id, anonymous_id, session_id, name,
    CASE WHEN type <> 'identify' THEN '{{"k":' || k || ',"value":' || value || '}}' END
      AS properties,
    CASE WHEN type = 'identify' THEN '{{"plan":"p' || (user_no % 4) || '"}}' END AS traits
  FROM c"""
SQL["to_stored"] = f"""{BASE}
  SELECT event_id, occurred_at, received_at, TIMESTAMP '2024-12-31' AS processed_at,
    strftime(occurred_at, '%Y-%m-%d') AS dt FROM c"""
SQL["derive_keys"] = f"""{BASE}
  SELECT app_id AS pk, occurred_at_iso || '#' || event_id AS sk,
    app_id || '#' || coalesce(user_id, 'anonymous') AS gsi1pk,
    occurred_at_iso || '#' || event_id AS gsi1sk,
    app_id || '#' || coalesce(session_id, 'no-session') AS gsi2pk,
    occurred_at_iso || '#' || event_id AS gsi2sk,
    epoch_us(occurred_at) // 1000 AS occurred_at_ms,
    epoch_us(occurred_at) // 1000000 + 365 * 86400 AS expires_at, name FROM c"""
SQL["derive_day_keys"] = f"""{BASE}, k AS (
  SELECT *, 'APP#' || app_id AS a, '#DAY#' || strftime(occurred_at, '%Y-%m-%d') AS d FROM c)
  SELECT a || d AS day_pk, 'TS#' || (epoch_us(occurred_at) // 1000) || '#EVT#' || event_id
      AS day_sk,
    a || '#USER#' || user_id || d AS user_day_pk,
    a || '#ANON#' || anonymous_id || d AS anonymous_day_pk FROM k"""
SQL["canonicalize_session"] = f"""{BASE}, s AS (
  SELECT event_id, CASE WHEN n % 2 = 1 OR n % 10 = 0 THEN session_id END AS a,
    CASE WHEN n % 14 = 1 THEN '' WHEN n % 2 = 0 THEN session_id || 'c' END AS x FROM c)
  SELECT event_id, CASE WHEN coalesce(x, '') = '' AND coalesce(a, '') <> '' THEN NULL ELSE a END
      AS actor_session_id,
    CASE WHEN coalesce(x, '') = '' AND coalesce(a, '') <> '' THEN a ELSE x END AS session_id
  FROM s"""
SQL["expires_at"] = f"""{BASE}
  SELECT event_id, epoch_us(occurred_at + INTERVAL 365 DAY) // 1000000 AS expires_at FROM c"""
SQL["ttl_remaining"] = f"""{BASE}
  SELECT event_id, greatest(0, CAST(floor((epoch_us(occurred_at + INTERVAL 350 DAY)
    - epoch_us(TIMESTAMP '2024-12-31')) / 1000000) AS BIGINT)) AS ttl FROM c"""

REDACTED = """
  SELECT doc_id, md5(text) AS note_md5, '[REDACTED]' AS user_email, '[REDACTED]' AS api_key, lang,
    source AS origin, '[REDACTED]' AS description, '[REDACTED]' AS session_count, n_chars AS size,
    '[REDACTED]' AS password, md5(text) AS body_md5, lang AS second_body FROM documents"""
SQL["redact_props"] = REDACTED
SQL["redact_any_depth"] = REDACTED

# ------------------------------------------------------------------ parse and validate

SQL["parse_bodies"] = f"""{BATCHES}
  SELECT batch_id,
    CASE w % 23 WHEN 7 THEN 'Invalid JSON in request body' WHEN 9 THEN 'Missing request body' END
      AS reject, w % 23 NOT IN (7, 9) AS parsed FROM sizes"""
SQL["explode_events"] = f"{BATCHES} SELECT batch_id, idx AS event_index, event_id, type FROM b"
SQL["batch_summary"] = f"""{BATCHES}
  SELECT batch_id, count(*) AS event_count, count(r) = 0 AS accepted,
    string_agg(CASE WHEN r = 2 THEN 'not-a-uuid' ELSE event_id END, ',' ORDER BY n) AS event_ids
  FROM b GROUP BY batch_id"""
SQL["stamp_batches"] = f"""
  SELECT event_id AS row_no, {uuid("CAST(event_id AS VARCHAR)")} AS batch_id,
    CASE event_id % 4 WHEN 0 THEN upper({uuid("'h' || event_id")})
      WHEN 1 THEN {uuid("CAST(event_id AS VARCHAR)")}
      ELSE {uuid("'request:' || event_id")} END AS request_id,
    TIMESTAMP '2024-12-31' AS received_at FROM events"""
SQL["strip_unknown"] = f"""{BATCHES}
  SELECT batch_id, idx AS event_index, event_id, app_id, type, name, occurred_at, platform,
    'prod' AS env, user_id, anonymous_id, session_id, CAST(NULL AS VARCHAR) AS actor_session_id,
    CASE WHEN n % 7 = 0 THEN 255 END AS app_version_length,
    session_id AS context_session_id,
    CASE WHEN type = 'page' THEN 'https://example.com/p/' || n END AS page_url,
    CAST(NULL AS VARCHAR) AS page_unknown,
    CASE WHEN n % 6 = 0 THEN TRUE END AS consent_analytics,
    CASE WHEN type <> 'identify' AND n % 29 NOT IN (1, 2, 3, 4) THEN k END AS k,
    CASE WHEN type = 'identify' THEN 'p' || (user_no % 4) END AS plan
  FROM b"""

# Rule, path, message and code of each injected fault.
FAULTS = (
    ("schema_version", "schemaVersion", 'Invalid literal value, expected "1.0.0"',
     "invalid_literal"),
    ("event_id", "eventId", "Invalid uuid", "invalid_string"),
    ("occurred_at", "occurredAt", "Invalid datetime", "invalid_string"),
    ("event_type", "type",
     "Invalid discriminator value. Expected 'track' | 'page' | 'identify'",
     "invalid_union_discriminator"),
    ("event_name", "name", "Event name must be lowercase snake_case with optional dot namespaces",
     "invalid_string"),
    ("event_name", "name", "Required", "invalid_type"),
    ("source", "source.platform",
     "Invalid enum value. Expected 'web' | 'ios' | 'android' | 'server', received 'tv'",
     "invalid_enum_value"),
    ("source", "source.env",
     "Invalid enum value. Expected 'dev' | 'staging' | 'prod' | 'test', received 'production'",
     "invalid_enum_value"),
    ("source", "source.appVersion", "String must contain at most 255 character(s)", "too_big"),
    ("actor", "actor", "At least one of userId or anonymousId must be present", "custom"),
    ("context", "context.locale", "String must contain at most 50 character(s)", "too_big"),
    ("consent", "consent.analytics", "Expected boolean, received string", "invalid_type"),
    ("consent", "consent.timestamp", "Required", "invalid_type"),
    ("property_key", "properties", "Properties must not exceed depth of 3", "custom"),
    ("property_depth", "properties", "Properties must not exceed depth of 3", "custom"),
    ("keys_per_level", "properties", "Properties must not exceed depth of 3", "custom"),
    ("array_length", "properties", "Properties must not exceed depth of 3", "custom"),
    ("string_length", "properties", "String values must not exceed 2048 characters", "custom"),
    ("traits", "traits", "Traits must not exceed depth of 3", "custom"),
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FAULT_TABLE = "faults(r, rule, path, message, code) AS (VALUES " + ", ".join(
    f"({number}, {', '.join(quoted(part) for part in row)})"
    for number, row in enumerate(FAULTS, 1)) + ")"

SQL["validation_issues"] = f"""{BATCHES}, {FAULT_TABLE}
  SELECT batch_id, idx AS event_index, rule, 'events.' || idx || '.' || path AS path, message, code
  FROM b JOIN faults USING (r)"""
SQL["envelope_issues"] = f"""{BATCHES}
  SELECT batch_id, CAST(NULL AS INTEGER) AS event_index,
    CASE w % 23 WHEN 5 THEN 'sent_at' WHEN 15 THEN 'payload_size' ELSE 'batch_size' END AS rule,
    CASE w % 23 WHEN 5 THEN 'sentAt' WHEN 15 THEN '' ELSE 'events' END AS path,
    CASE w % 23 WHEN 5 THEN 'Invalid datetime'
      WHEN 11 THEN 'Batch must contain at least 1 event'
      WHEN 13 THEN 'Batch must not exceed 100 events per request'
      ELSE 'Payload size must not exceed 65536 bytes' END AS message,
    CASE w % 23 WHEN 5 THEN 'invalid_string' WHEN 11 THEN 'too_small' WHEN 13 THEN 'too_big'
      ELSE 'custom' END AS code
  FROM sizes WHERE w % 23 IN (5, 11, 13, 15)
  UNION ALL
  SELECT batch_id, NULL, 'payload_size', '', 'Payload size must not exceed 65536 bytes', 'custom'
  FROM sizes WHERE w % 23 = 13"""

VERDICT = f"""{FAULT_TABLE},
v AS (
  SELECT batch_id, count(b.r) AS broken, count(*) AS events,
    min_by(message, n) FILTER (b.r IS NOT NULL) AS message
  FROM b LEFT JOIN faults USING (r) GROUP BY batch_id)"""
SQL["gate_batches"] = f"""{BATCHES}, {VERDICT}
  SELECT batch_id, broken = 0 AS accepted, CASE WHEN broken > 0 THEN events ELSE 0 END AS failed,
    CASE WHEN broken > 0 THEN 'batch' END AS error_event_id,
    CASE WHEN broken > 0 THEN 'Validation failed: ' || message END AS error FROM v"""
SQL["sanitize_messages"] = """
  SELECT doc_id, md5(CASE WHEN regexp_matches(lower(text),
    'password|token|secret|key|authorization') THEN 'Validation error occurred' ELSE text END)
    AS message_md5 FROM documents"""

# ------------------------------------------------------------------ raw batches

LOCATION = """'raw-events/' || app_id || '/' || strftime(received_at, '%Y/%m/%d') || '/' || batch_id
  || '_' || (epoch_us(received_at) // 1000) || '.json'"""

SQL["raw_key"] = f"""{ALL_DELIVERIES}
  SELECT batch_id, {request_of("batch_key")} AS request_id, sent AS event_count, app_id,
    strftime(received_at, '%Y') AS "year", strftime(received_at, '%m') AS "month",
    strftime(received_at, '%d') AS "day", {LOCATION} AS storage_location FROM d"""
SQL["make_pointers"] = f"""{ALL_DELIVERIES}
  SELECT batch_id, {request_of("batch_key")} AS request_id, received_at,
    {LOCATION} AS storage_location FROM d"""
SQL["write_raw_batches"] = f"""{ALL_DELIVERIES}
  SELECT batch_id, {request_of("batch_key")} AS request_id, received_at, sent AS event_count,
    app_id, {LOCATION} AS storage_location FROM d"""
SQL["raw_partitions_hive"] = f"""{ALL_DELIVERIES}
  SELECT d.batch_id, b.idx AS event_index, b.event_id, b.app_id, 'prod' AS env,
    strftime(d.received_at, '%Y-%m-%d') AS dt, strftime(d.received_at, '%H') AS "hour"
  FROM b JOIN d USING (batch_key)"""
SQL["decode_pointers"] = f"""{ALL_DELIVERIES}, forms(form) AS (VALUES ('plain'), ('base64'), ('torn'))
  SELECT form, CASE WHEN form <> 'torn' THEN batch_id END AS batch_id,
    CASE WHEN form <> 'torn' THEN {request_of("batch_key")} END AS request_id,
    CASE WHEN form <> 'torn' THEN received_at END AS received_at,
    CASE WHEN form <> 'torn' THEN {LOCATION} END AS storage_location,
    CASE WHEN form = 'torn' THEN 'Failed to parse queue message: not a JSON object' END AS reject
  FROM d CROSS JOIN forms"""
SQL["resolve_pointers"] = f"""{ALL_DELIVERIES}
  SELECT batch_id, {request_of("batch_key")} AS request_id,
    CASE WHEN w % 23 <> 17 THEN sent END AS events,
    CASE WHEN w % 23 = 17 THEN 'Failed to fetch raw batch: Raw batch not found: ' || batch_id END
      AS error FROM d"""
SQL["replay_raw"] = f"""{ALL_DELIVERIES}
  SELECT batch_id, {request_of("batch_key")} AS request_id, received_at,
    {LOCATION} AS storage_location FROM d
  WHERE received_at >= TIMESTAMP '2024-01-05' AND received_at < TIMESTAMP '2024-01-21'"""

# ------------------------------------------------------------------ idempotency and processing

SQL["events_exist"] = f"""{BASE}
  SELECT event_id, occurred_at < TIMESTAMP '2024-01-16' AS "exists" FROM c"""

# Every delivered copy of every event.
COPIES = f"""
copies AS (
  SELECT c.*, {uuid("c.app_id || '-' || c.w")} AS batch_id, c.n * 2 + k2 AS event_index
  FROM c CROSS JOIN (VALUES (0), (1)) t(k2) WHERE k2 = 0 OR n % 200 = 0),
delivered AS (
  SELECT event_id, app_id, occurred_at, received_at, value, batch_id, event_index, w
  FROM copies
  UNION ALL
  SELECT event_id, app_id, occurred_at, received_at + INTERVAL 1 HOUR, value + 1,
    {uuid("app_id || '-' || w || '-again'")}, event_index, w
  FROM copies WHERE w % 4 = 0)"""
SQL["split_duplicates"] = f"""{BASE}, {COPIES}
  SELECT batch_id, event_index, event_id,
    CASE WHEN occurred_at < TIMESTAMP '2024-01-16' THEN 'Duplicate event (already processed)' END
      AS reason FROM delivered"""
SQL["dedup_within"] = f"""{BASE}, {COPIES}
  SELECT event_id, batch_id, n * 2 AS event_index, value FROM copies WHERE event_index = n * 2"""
SQL["append_events"] = f"""{BASE}
  SELECT event_id, app_id, occurred_at, received_at,
    strftime(occurred_at, '%Y-%m-%d') AS dt FROM c"""
SQL["upsert_events"] = f"""{BASE}
  SELECT event_id, app_id, occurred_at,
    CASE WHEN w % 4 = 0 THEN received_at + INTERVAL 1 HOUR ELSE received_at END AS received_at,
    CASE WHEN w % 4 = 0 THEN value + 1 ELSE value END AS value
  FROM c WHERE w % 4 = 0 OR occurred_at < TIMESTAMP '2024-01-16'"""
SQL["upsert_stats"] = f"""{BASE}
  SELECT app_id, count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-16') AS created,
    count(*) FILTER (occurred_at < TIMESTAMP '2024-01-16') AS updated FROM c GROUP BY app_id"""

# Clean, surviving first deliveries store what the store does not hold yet.
SQL["process_batches"] = f"""{BATCHES}
  SELECT event_id, b.app_id, type, name, occurred_at, user_id, session_id, b.batch_id,
    s.received_at AS received_at, TIMESTAMP '2024-12-31' AS processed_at
  FROM b JOIN sizes s USING (batch_key)
  WHERE s.broken = 0 AND b.w % 23 <> 17 AND occurred_at >= TIMESTAMP '2024-01-04'"""

REPORT = """
  fresh AS (
    SELECT batch_key, count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-04') AS new,
      count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-04' AND n % 200 = 0) AS new_twice
    FROM b GROUP BY batch_key),
  f AS (
    SELECT d.*, new, new_twice, d.batch_id <> sizes.batch_id AS again
    FROM d JOIN fresh USING (batch_key) JOIN sizes USING (batch_key))"""
SQL["batch_report"] = f"""{ALL_DELIVERIES}, {REPORT}
  SELECT batch_id,
    CASE WHEN w % 23 = 17 OR broken > 0 OR again THEN 0 ELSE new + new_twice END AS processed,
    CASE WHEN w % 23 <> 17 AND broken > 0 THEN sent + twice ELSE 0 END AS failed,
    CASE WHEN w % 23 = 17 OR broken > 0 OR again THEN 0 ELSE new END AS stored,
    CASE WHEN w % 23 = 17 OR broken > 0 THEN 0 WHEN again THEN sent + twice
      ELSE sent + twice - new - new_twice END AS skipped,
    CASE WHEN w % 23 = 17 THEN 'missing' WHEN broken > 0 THEN 'rejected'
      WHEN again OR new = 0 THEN 'all_duplicates' ELSE 'processed' END AS outcome
  FROM f"""
SQL["write_failures"] = f"""{ALL_DELIVERIES}, {REPORT}
  SELECT batch_id,
    CASE WHEN again OR app_id = 'app2' THEN 0 ELSE new END AS processed,
    CASE WHEN NOT again AND app_id = 'app2' THEN new ELSE 0 END AS failed,
    CASE WHEN again OR app_id = 'app2' THEN 0 ELSE new END AS stored,
    CASE WHEN again THEN sent ELSE sent - new END AS skipped,
    CASE WHEN again OR new = 0 THEN 'all_duplicates' WHEN app_id = 'app2' THEN 'write_failed'
      ELSE 'processed' END AS outcome
  FROM f"""
REASONS = f"""{FAULT_TABLE},
  m AS (SELECT batch_key, min_by(message, n) FILTER (b.r IS NOT NULL) AS message
    FROM b LEFT JOIN faults USING (r) GROUP BY batch_key)"""
SQL["batch_errors"] = f"""{ALL_DELIVERIES}, {REASONS}
  SELECT batch_id, 'batch' AS event_id,
    CASE WHEN w % 23 = 17 THEN 'Failed to fetch raw batch: Raw batch not found: ' || batch_id
      ELSE 'Validation failed: ' || message END AS error
  FROM d JOIN m USING (batch_key) WHERE w % 23 = 17 OR broken > 0"""
SQL["dead_letters"] = f"""{ALL_DELIVERIES}, {REASONS}
  SELECT batch_id, {request_of("batch_key")} AS request_id, received_at,
    sent + twice AS event_count, 'Validation failed: ' || message AS reason
  FROM d JOIN m USING (batch_key) WHERE w % 23 <> 17 AND broken > 0"""
SQL["redrive"] = """
  SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_id, count(*) AS receives,
    CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'done'
      WHEN count(*) >= 3 THEN 'dead_letter' ELSE 'redeliver' END AS state
  FROM events GROUP BY 1"""

# ------------------------------------------------------------------ layouts and retention

SQL["build_layouts"] = f"""{BASE}, layouts(layout) AS (VALUES ('app'), ('user'), ('session'))
  SELECT layout, app_id, count(*) AS events,
    CAST(sum(epoch_us(occurred_at) % 1000003) AS BIGINT) AS checksum,
    count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions
  FROM c CROSS JOIN layouts GROUP BY layout, app_id"""


def layout_page(label: str, where: str) -> str:
    return f"""SELECT * FROM (
      SELECT '{label}' AS layout, row_number() OVER (ORDER BY occurred_at DESC) AS pos, event_id,
        count(*) OVER () > 20 AS has_more
      FROM c WHERE app_id = 'app1' AND occurred_at >= TIMESTAMP '2024-01-02'
        AND occurred_at < TIMESTAMP '2024-01-30' AND {where}) WHERE pos <= 20"""


SQL["layout_pages"] = f"""{BASE} {layout_page("app", "TRUE")}
  UNION ALL {layout_page("user", "user_id = 'user_7'")}
  UNION ALL {layout_page("session", "session_id = 'sess_7_20240105'")}"""
SQL["purge_expired"] = f"""{BASE}
  SELECT event_id, occurred_at FROM c
  WHERE epoch_us(occurred_at) // 1000000 + 340 * 86400 > epoch_us(TIMESTAMP '2024-12-31') // 1000000"""
SQL["purge_actions"] = f"""{BASE}
  SELECT app_id, strftime(occurred_at, '%Y-%m-%d') AS dt, count(*) AS events,
    CASE WHEN strftime(occurred_at, '%Y-%m-%d') < '2024-01-26' THEN 'drop'
      WHEN strftime(occurred_at, '%Y-%m-%d') = '2024-01-26' THEN 'rewrite' ELSE 'keep' END AS action
  FROM c GROUP BY 1, 2"""
SQL["upsert_store"] = f"""{BASE}, m AS (
  SELECT *, CASE WHEN user_no % 5 = 2 OR w % 4 = 0 THEN occurred_at + INTERVAL 40 DAY
    ELSE occurred_at END AS late FROM c)
  SELECT ['app1', 'shop:eu', 'z/../app_id=app1', 'a/b', '50%'][user_no % 5 + 1] AS app_id,
    event_id, late AS occurred_at, strftime(late, '%Y-%m-%d') AS dt FROM m"""
SQL["stream_compact_upsert"] = f"""{BASE}
  SELECT event_id, app_id, CASE WHEN app_id = 'app1' THEN 'changed' ELSE name END AS name,
    strftime(occurred_at, '%Y-%m-%d') AS dt FROM c"""
SQL["purge_store"] = f"""{BASE}
  SELECT event_id, occurred_at FROM c WHERE epoch_us(occurred_at) // 1000000 + 340 * 86400
    > epoch_us(TIMESTAMP '2024-12-31 07:30:00') // 1000000"""

SQL["compact_store"] = f"""{BASE}
  SELECT app_id, event_id, moment AS occurred_at, strftime(moment, '%Y-%m-%d') AS dt FROM (
    SELECT app_id, event_id, occurred_at AS moment FROM c
    UNION ALL SELECT app_id, event_id, occurred_at + INTERVAL 1 HOUR FROM c
    WHERE app_id = 'app1' AND type = 'page')"""
SQL["purge_then_append"] = f"""{BASE}
  SELECT event_id, CASE WHEN epoch_us(occurred_at) // 1000000 + 340 * 86400
      > epoch_us(TIMESTAMP '2024-12-31 07:30:00') // 1000000 THEN name ELSE 'again' END AS name,
    strftime(occurred_at, '%Y-%m-%d') AS dt FROM c"""
SQL["store_version"] = f"""{BASE}
  SELECT 'old' AS reader, event_id, name FROM c
  UNION ALL SELECT 'new', event_id, CASE WHEN app_id = 'app1' THEN 'changed' ELSE name END FROM c"""


def tiers(names: tuple[str, str, str], second: str, third: str) -> str:
    age = "date_diff('day', CAST(received_at AS DATE), DATE '2024-04-14')"
    return f"""{BATCHES}
      SELECT CASE WHEN {age} {third} THEN '{names[2]}' WHEN {age} {second} THEN '{names[1]}'
        ELSE '{names[0]}' END AS tier, count(*) AS batches, CAST(sum(sent) AS BIGINT) AS events
      FROM sizes GROUP BY 1"""


SQL["raw_tiers"] = tiers(("standard", "infrequent_access", "archive_instant"), ">= 90", ">= 180")
SQL["raw_tiers_cool"] = tiers(("hot", "cool", "archive"), "> 30", "> 90")

# ------------------------------------------------------------------ health


def alarm(stats: str, threshold: float, periods: int, seconds: int, keys: str = "",
          stat: str = "stat") -> str:
    """All windows laid out without gaps; the alarm needs every one of the last
    ``periods`` windows to breach."""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"{keys}, " if keys else ""
    return f"""stats AS ({stats}),
      span AS (SELECT {group} min(w) AS lo, max(w) AS hi FROM stats
        {"GROUP BY " + keys if keys else ""}),
      grid AS (SELECT {group} unnest(generate_series(lo, hi)) AS w FROM span),
      filled AS (SELECT {group} w, stat, coalesce(stat > {threshold}, FALSE) AS breach
        FROM grid LEFT JOIN stats USING ({group} w)),
      judged AS (SELECT *, sum(CASE WHEN breach THEN 1 ELSE 0 END) OVER ({part} ORDER BY w
        ROWS BETWEEN {periods - 1} PRECEDING AND CURRENT ROW) = {periods} AS alarm FROM filled)
    SELECT {group} TIMESTAMP '1970-01-01' + to_seconds(w * {seconds}) AS window_start,
      {stat}, breach, alarm FROM judged WHERE stat IS NOT NULL"""


def window(ts: str, seconds: int) -> str:
    return f"epoch_us({ts}) // 1000000 // {seconds}"


SQL["alarm_errors"] = f"""{BATCHES}, {alarm(
    f"SELECT {window('received_at', 21600)} AS w, CAST(sum(CASE WHEN broken > 0 THEN 1 ELSE 0 END)"
    " AS BIGINT) AS stat FROM sizes GROUP BY 1", 1, 2, 21600)}"""


def status_part(label: str, condition: str, threshold: int) -> str:
    inner = alarm(
        f"SELECT {window('ts', 3600)} AS w, count(*) FILTER ({condition}) AS stat"
        " FROM events GROUP BY 1", threshold, 2, 3600)
    return f"SELECT '{label}' AS status_class, * FROM (WITH {inner})"


SQL["alarm_status"] = (
    status_part("4xx", "event_type = 'signup'", 3) + " UNION ALL "
    + status_part("5xx", "event_type = 'error'", 4))
SQL["alarm_latency"] = f"""{BASE}, {alarm(
    f"SELECT app_id, {window('received_at', 3600)} AS w,"
    " avg((epoch_us(processed_at) - epoch_us(received_at)) / 1000) AS stat FROM c GROUP BY 1, 2",
    950, 3, 3600, "app_id")}"""
SQL["backlog_age"] = f"""{BASE},
  p AS (SELECT received_at, CASE WHEN type <> 'page'
    THEN received_at + to_minutes(n % 90) ELSE TIMESTAMP '9999-01-01' END AS done FROM c),
  ends AS (SELECT unnest(generate_series(
    (SELECT min({window('received_at', 3600)}) FROM p),
    epoch_us(TIMESTAMP '2024-02-01') // 1000000 // 3600 - 1)) AS w),
  {alarm(
    "SELECT w, CAST((w + 1) * 3600 - min(epoch_us(received_at) // 1000000) AS BIGINT) AS stat"
    f" FROM ends JOIN p ON {window('received_at', 3600)} <= w"
    f" AND {window('done', 3600)} > w GROUP BY w", 600, 2, 3600)}"""
SQL["dlq_depth"] = f"""{ALL_DELIVERIES}, {alarm(
    f"SELECT {window('received_at', 3600)} AS w, count(*) AS stat FROM d"
    " WHERE w % 23 <> 17 AND broken > 0 GROUP BY 1", 0, 1, 3600)}"""

# ------------------------------------------------------------------ streams

SQL["stream_ingest"] = f"""{ALL_DELIVERIES}
  SELECT received_at, app_id, sent + twice AS event_count FROM d WHERE broken = 0"""
SQL["stream_rejects"] = f"""{ALL_DELIVERIES}, {REASONS}
  SELECT received_at, message AS reason FROM d JOIN m USING (batch_key) WHERE broken > 0"""
SQL["stream_process"] = f"""{BASE}
  SELECT event_id, app_id, type, name, occurred_at, user_id, session_id,
    strftime(occurred_at, '%Y-%m-%d') AS dt FROM c"""
SQL["stream_dead_letters"] = f"""{ALL_DELIVERIES}, {REASONS}
  SELECT batch_id, received_at, sent + twice AS event_count,
    'Validation failed: ' || message AS reason
  FROM d JOIN m USING (batch_key) WHERE broken > 0"""
SQL["stream_dedup_watermark"] = f"{BASE} SELECT event_id, app_id FROM c"
SQL["stream_alarm"] = f"""WITH {alarm(
    f"SELECT {window('ts', 3600)} AS w, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)"
    " AS BIGINT) AS stat FROM events GROUP BY 1", 3, 2, 3600)}
  AND (w + 1) * 3600000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)"""
