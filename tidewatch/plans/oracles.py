"""SQL for the registered queries, written from the semantics and runnable on the same tables.

Windows express duplicate cycles and trailing counts. The life cycle and the incidents are written
as recursive queries that take one row after the other, unlike the DataFrame forms they check.
"""

EV = """
ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 20000 AS ts_ms,
         CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k, user_id % 5 AS b
  FROM events
)"""

_ISO = """strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN {0} % 1000 = 0 THEN 'Z' ELSE '.' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0') || 'Z' END"""


def iso(ms: str) -> str:
    return _ISO.format(ms)


def short(prefix: str, *parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"'{prefix}-' || upper(substr(md5({text}), 1, 8))"


_SEVERITY = """CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'HIGH' WHEN value >= 10 THEN 'WARNING'
  WHEN value >= 5 THEN 'INFO' ELSE 'MEDIUM' END"""

CANON = EV + f""",
named AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'DatabaseConnectionTimeout' WHEN 'click' THEN 'HighCPUUsage'
    WHEN 'view' THEN 'HighHTTP5xxErrorRate' WHEN 'purchase' THEN 'PodCrashLoopBackOff' ELSE 'DiskSpaceLow' END AS nm
  FROM ev
),
placed AS (
  SELECT *, CASE WHEN k = 15 THEN 1 ELSE 0 END AS alert_pos, CASE WHEN k = 99 THEN 'UnknownAlert' ELSE nm END AS alert_name
  FROM named WHERE k NOT IN (13, 14, 63)
  UNION ALL
  SELECT *, 1 AS alert_pos, 'DiskSpaceLow' AS alert_name FROM named WHERE k = 16
),
described AS (
  SELECT event_id AS seq, CAST(alert_pos AS BIGINT) AS alert_pos, ts_ms AS ms, alert_name, k, b, user_id, event_type AS type,
    CASE WHEN k % 2 = 0 THEN 'RESOLVED' ELSE 'FIRING' END AS status,
    {_SEVERITY} AS severity,
    CASE WHEN b = 0 THEN 'payment-service' WHEN b = 4 THEN 'default-service' ELSE 'svc-' || b END AS service,
    CASE WHEN b = 4 THEN 'cluster-resource-01' ELSE 'host-' || b END AS rid,
    CASE b WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS env,
    CASE WHEN k = 97 THEN 'not a time' ELSE {iso('ts_ms')} END AS stamp,
    CASE WHEN event_type = 'view' THEN NULL ELSE 'fp-' || user_id END AS fp
  FROM placed
),
canon AS (
  SELECT *, {short('EVT', "'events-0-' || seq", 'alert_pos')} AS event_id,
    'grafana:' || alert_name || ':' || service || ':' || rid AS key,
    CASE
      WHEN severity = 'CRITICAL' THEN 'P1'
      WHEN severity = 'HIGH' THEN CASE WHEN contains(lower(alert_name), 'database') OR contains(lower(alert_name), 'deadlock')
        OR contains(lower(service), 'payment') THEN 'P1' ELSE 'P2' END
      WHEN severity IN ('MEDIUM', 'WARNING') THEN 'P3' ELSE 'P4' END AS priority
  FROM described
)"""

DEDUP = CANON + """,
lagged AS (
  SELECT *, lag(ms) OVER w AS p_ms, lag(status) OVER w AS p_status, first_value(env) OVER w AS group_env
  FROM canon WINDOW w AS (PARTITION BY key ORDER BY ms, seq, alert_pos)
),
flagged AS (
  SELECT *, p_ms IS NULL OR ms - p_ms > 300000 AS reset FROM lagged
),
cycled AS (
  SELECT *, reset OR status <> p_status AS is_new,
    sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, seq, alert_pos) AS cycle
  FROM flagged
),
grouped AS (
  SELECT *, row_number() OVER w AS n, first_value(ms) OVER w AS first_ms, first_value(stamp) OVER w AS first_stamp
  FROM cycled WINDOW w AS (PARTITION BY key, cycle ORDER BY ms, seq, alert_pos)
),
hashed AS (
  SELECT key, 'GRP-' || printf('%X', list_reduce(
    list_prepend(CAST(0 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda acc, c: (acc * 31 + c) % 4294967296)) AS group_id
  FROM (SELECT DISTINCT key FROM canon)
)"""

LIFE = "WITH RECURSIVE " + DEDUP + f""",
uniq AS (
  SELECT key, alert_name, service, env, status, priority, rid, ms, seq, alert_pos,
    row_number() OVER (PARTITION BY key ORDER BY ms, seq, alert_pos) AS n
  FROM cycled WHERE is_new
),
life AS (
  SELECT key, n, ms, seq, alert_pos, 'NONE' AS prev_state,
    CASE status WHEN 'FIRING' THEN 'OPEN' ELSE 'RESOLVED' END AS state,
    CASE status WHEN 'FIRING' THEN 'CREATED' ELSE 'RESOLVED' END AS transition,
    ms AS opened, CAST(0 AS BIGINT) AS toggles, ms AS resolved_at, ms AS identity
  FROM uniq WHERE n = 1
  UNION ALL
  SELECT key, n, ms, seq, alert_pos, prev_state,
    CASE verdict WHEN 'RESOLVED' THEN 'RESOLVED' WHEN 'FLAPPING_DETECTED' THEN 'FLAPPING' WHEN 'REOPENED' THEN 'REOPENED'
      WHEN 'CREATED' THEN 'OPEN' ELSE prev_state END,
    verdict, opened, toggles,
    CASE verdict WHEN 'RESOLVED' THEN ms ELSE resolved_at END,
    CASE verdict WHEN 'CREATED' THEN ms ELSE identity END
  FROM (
    SELECT *, CASE
      WHEN status = 'RESOLVED' THEN CASE prev_state WHEN 'RESOLVED' THEN 'ALREADY_RESOLVED' ELSE 'RESOLVED' END
      WHEN prev_state = 'FLAPPING' THEN 'FLAPPING_HELD'
      WHEN prev_state <> 'RESOLVED' THEN 'UPDATED'
      WHEN toggles > 3 THEN 'FLAPPING_DETECTED'
      WHEN ms - resolved_at <= 600000 THEN 'REOPENED' ELSE 'CREATED' END AS verdict
    FROM (
      SELECT u.key, u.n, u.ms, u.seq, u.alert_pos, u.status, l.state AS prev_state, l.resolved_at, l.identity,
        CASE WHEN u.ms - l.opened > 300000 THEN u.ms ELSE l.opened END AS opened,
        CASE WHEN u.ms - l.opened > 300000 THEN 0 ELSE l.toggles END
          + CASE WHEN (u.status = 'RESOLVED') <> (l.state = 'RESOLVED') THEN 1 ELSE 0 END AS toggles
      FROM life l JOIN uniq u ON u.key = l.key AND u.n = l.n + 1
    )
  )
),
changes AS (
  SELECT u.*, l.prev_state, l.state, l.transition, l.identity, {short('ALT', 'u.key', 'l.identity')} AS alert_id
  FROM life l JOIN uniq u USING (key, n)
)"""

# A run over the rows of each service, one after the other, with the members in a list.
INCIDENTS = LIFE + f""",
queue AS (
  SELECT *, lower(alert_name) AS low, key || '|' || identity AS ident,
    row_number() OVER (PARTITION BY service ORDER BY ms, seq, alert_pos) AS i
  FROM changes
),
run AS (
  SELECT service, i, ms, seq, alert_pos, state <> 'RESOLVED' AS out, state <> 'RESOLVED' AS live, ms AS created, seq AS created_seq,
    ms AS updated, env AS inc_env, priority AS inc_priority, alert_id AS root_id, alert_name AS root_name,
    [ident] AS idents, [alert_id] AS ids, [alert_name] AS names
  FROM queue WHERE i = 1
  UNION ALL
  SELECT service, i, ms, seq, alert_pos, NOT fresh OR state <> 'RESOLVED', live OR state <> 'RESOLVED',
    CASE WHEN begins THEN ms ELSE created END, CASE WHEN begins THEN seq ELSE created_seq END,
    CASE WHEN begins OR NOT fresh THEN ms ELSE updated END,
    CASE WHEN begins THEN env ELSE inc_env END,
    CASE WHEN begins THEN priority WHEN NOT fresh AND (keyword OR priority = 'P1') THEN 'P1' ELSE inc_priority END,
    CASE WHEN begins OR (keyword AND NOT fresh) THEN alert_id ELSE root_id END,
    CASE WHEN begins OR (keyword AND NOT fresh) THEN alert_name ELSE root_name END,
    CASE WHEN begins THEN [ident] WHEN joins THEN list_append(idents, ident) ELSE idents END,
    CASE WHEN begins THEN [alert_id] WHEN joins THEN list_append(ids, alert_id) ELSE ids END,
    CASE WHEN begins THEN [alert_name] WHEN joins THEN list_append(names, alert_name) ELSE names END
  FROM (
    SELECT *, fresh AND state <> 'RESOLVED' AS begins, NOT fresh AND NOT list_contains(idents, ident) AS joins,
      contains(low, 'database') OR contains(low, 'timeout') OR contains(low, 'connection') AS keyword
    FROM (
      SELECT q.*, r.live, r.created, r.created_seq, r.updated, r.inc_env, r.inc_priority, r.root_id, r.root_name,
        r.idents, r.ids, r.names, NOT r.live OR q.ms - r.updated > 300000 AS fresh
      FROM run r JOIN queue q ON q.service = r.service AND q.i = r.i + 1
    )
  )
),
incidents AS (
  SELECT *, {short('INC', 'service', 'created', 'created_seq')} AS incident_id, CAST(len(ids) AS BIGINT) AS member_count,
    'Degradation in ' || service || ': ' || root_name || ' (' || len(ids) || ' alerts correlated)' AS title
  FROM run WHERE out
)"""

_NUMBERED = """(SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY ms DESC, seq DESC, alert_pos DESC) AS back FROM {1})"""

_UUID = """substr(md5(alert_name), 1, 8) || '-' || substr(md5(alert_name), 9, 4) || '-3' || substr(md5(alert_name), 14, 3) || '-' ||
  lower(printf('%x', (CAST('0x' || substr(md5(alert_name), 17, 2) AS INTEGER) & 63) | 128)) || substr(md5(alert_name), 19, 2)
  || '-' || substr(md5(alert_name), 21, 12)"""

PAY = EV + """,
pay AS (
  SELECT event_id AS seq, k % 4 = 0 AS cdc, 'TX-' || event_id AS tx, ts_ms AS ms,
    CASE WHEN k = 39 THEN 'UNKNOWN' ELSE 'ACC-' || (user_id % 25) END AS acct,
    CASE WHEN k = 33 THEN 0.0 WHEN k = 45 THEN 'NaN'::DOUBLE ELSE round(value * 100) END AS amount,
    CASE WHEN k % 4 = 0 THEN 'EUR' WHEN k = 37 THEN 'USD' ELSE 'GBP' END AS cur,
    CASE WHEN k % 4 = 0 THEN 'banking.public.bank_transactions' ELSE 'banking-payments' END AS topic,
    CASE k WHEN 96 THEN 'deleted row' WHEN 35 THEN 'bad amount' WHEN 41 THEN 'empty message' WHEN 43 THEN 'not an object' END AS rejected
  FROM ev
),
good AS (SELECT * FROM pay WHERE rejected IS NULL),
ranged AS (
  SELECT *, count(*) OVER (PARTITION BY acct ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS in_range,
    count(*) OVER (PARTITION BY acct, ms) AS same, row_number() OVER (PARTITION BY acct, ms ORDER BY seq) AS nth
  FROM good
),
counted AS (SELECT *, in_range - (same - nth) AS window_count FROM ranged)"""

FRAUD = PAY + f""",
hits AS (
  SELECT *, 'HIGH_VALUE_ANOMALY' AS rule, 'CRITICAL' AS severity,
    'Amount $' || format('{{:,.2f}}', amount) || ' exceeds $10,000 compliance threshold' AS details FROM counted WHERE amount >= 10000 AND NOT isnan(amount)
  UNION ALL
  SELECT *, 'VELOCITY_BURST_ATTACK', 'HIGH', window_count || ' transactions in 60s window — rapid velocity attack'
  FROM counted WHERE window_count >= 3
),
alerts AS (
  SELECT *, {short('ALT', 'topic', "'events-0-' || seq", 'rule')} AS alert_id, {iso('ms')} AS stamp FROM hits
)"""

MESSAGES = f""",
texts AS (
  SELECT e.k, p.topic, p.tx, e.ts_ms AS ms, 'ACC-' || (e.user_id % 25) AS acct, CASE WHEN e.k = 45 THEN '"NaN"' ELSE CAST(round(e.value * 100) AS VARCHAR) END AS amt,
    CASE WHEN e.k % 8 = 0 THEN CAST(e.ts_ms * 1000 AS VARCHAR) ELSE {iso('e.ts_ms')} END AS created
  FROM ev e JOIN pay p ON p.seq = e.event_id
),
messages AS (
  SELECT topic, CASE
    WHEN k = 96 THEN '{{"op":"d","ts_ms":' || ms || ',"after":null}}'
    WHEN k % 4 = 0 THEN '{{"op":"c","ts_ms":' || ms || ',"after":{{"transaction_id":"' || tx || '","account_id":"' || acct || '","amount":'
      || amt || ',"currency":"EUR","status":"BOOKED","created_at":"' || created || '"}}}}'
    WHEN k = 41 THEN '{{}}' WHEN k = 43 THEN '[1,2]'
    ELSE '{{' || CASE k WHEN 35 THEN '"amount":"oops",' WHEN 47 THEN '"amount":99999,' ELSE '' END || '"paymentId":"' || tx || '"'
      || CASE WHEN k = 39 THEN '' ELSE ',"sourceAccountIban":"' || acct || '"' END || ',"destAccountIban":"ACC-DEST"'
      || CASE WHEN k IN (33, 35) THEN '' ELSE ',"amount":' || amt END
      || CASE WHEN k = 37 THEN '' ELSE ',"currency":"GBP"' END || ',"timestamp":' || ms || '}}' END AS value
  FROM texts
)"""

PERF = EV + """,
perf AS (
  SELECT event_id AS run_id, event_type AS topic, ts_ms, k * 100 AS sent, CASE WHEN k = 11 THEN 5 ELSE 0 END AS failed, value, k
  FROM ev WHERE k <> 7
)"""

OFFSETS = EV + """,
post AS (SELECT event_type AS topic, event_id % 3 AS part, count(*) AS n FROM ev GROUP BY ALL),
pre AS (SELECT event_type AS topic, event_id % 3 AS part, count(*) AS n FROM ev WHERE ts_ms < (SELECT (min(ts_ms) + max(ts_ms)) // 2 FROM ev) GROUP BY ALL),
delta AS (SELECT topic, part, post.n - coalesce(pre.n, 0) AS records FROM post LEFT JOIN pre USING (topic, part))"""

REQ = EV + """,
who(idx, principal, grp, usr, mteam, wteam, rteam) AS (VALUES
  (0, 'User:admin', 'Kafka_Admins', 'admin', NULL, NULL, NULL),
  (1, 'team-a-reader', 'TeamA_Readers', 'team-a-reader', NULL, NULL, 'team-a'),
  (2, 'User:team-a-writer', 'TeamA_Writers', 'team-a-writer', NULL, 'team-a', NULL),
  (3, 'team-a-manager', 'TeamA_ResourceManagers', 'team-a-manager', 'team-a', NULL, NULL),
  (4, 'equities-reader', 'Equities_Readers', 'equities-reader', NULL, NULL, 'equities'),
  (5, 'User:equities-writer', 'Equities_Writers', 'equities-writer', NULL, 'equities', NULL),
  (6, 'equities-manager', 'Equities_ResourceManagers', 'equities-manager', 'equities', NULL, NULL),
  (7, 'User:fi-reader', 'FI_Readers', 'fi-reader', NULL, NULL, 'fi'),
  (8, 'fi-writer', 'FI_Writers', 'fi-writer', NULL, 'fi', NULL),
  (9, 'u-11', 'TeamB_Readers', 'u-11', NULL, NULL, 'team-b'),
  (10, 'u-12', NULL, 'u-12', NULL, NULL, NULL)
),
req AS (
  SELECT event_id AS request_id, w.*, k = 98 AS repl, k = 95 AS sysadmin,
    ['READ', 'WRITE', 'CREATE', 'DELETE', 'ALTER', 'DESCRIBE', 'ALTER_CONFIGS', 'DESCRIBE_CONFIGS'][(k % 8) + 1] AS operation,
    ['team-a-orders', 'team-b-inventory', 'equities-trades', 'equities-quotes', 'fi-bonds', 'fi-yields', 'Team-A-returns'][((k + user_id) % 7) + 1] AS resource,
    CASE event_type WHEN 'signup' THEN 'CLUSTER' WHEN 'error' THEN 'GROUP' ELSE 'TOPIC' END AS resource_type
  FROM ev JOIN who w ON w.idx = user_id % 11
),
ruled AS (
  SELECT *, repl AS internal_rule, sysadmin OR usr = 'admin' AS admin_rule,
    coalesce(starts_with(lower(resource), mteam || '-'), false) AS manager_rule,
    resource_type = 'CLUSTER' AND operation IN ('DESCRIBE', 'CREATE') AND mteam IS NOT NULL AS cluster_rule,
    coalesce(starts_with(lower(resource), wteam || '-'), false) AND operation IN ('WRITE', 'DESCRIBE', 'DESCRIBE_CONFIGS') AS writer_rule,
    coalesce(starts_with(lower(resource), rteam || '-'), false) AND operation IN ('READ', 'DESCRIBE', 'DESCRIBE_CONFIGS') AS reader_rule,
    coalesce(starts_with(lower(resource), rteam || '-'), false) AND operation IN ('READ', 'DESCRIBE') AND resource_type = 'GROUP' AS group_rule
  FROM req
),
decided AS (
  SELECT *, internal_rule OR admin_rule OR manager_rule OR cluster_rule OR writer_rule OR reader_rule OR group_rule AS allowed FROM ruled
),
binding(usr, type, prefix, ops) AS (VALUES
  ('admin', 'TOPIC', '', NULL), ('admin', 'GROUP', '', NULL), ('admin', 'CLUSTER', '', NULL),
  ('equities-manager', 'TOPIC', 'equities-', NULL), ('equities-manager', 'GROUP', 'equities-', NULL),
  ('equities-manager', 'CLUSTER', '', ['CREATE', 'DESCRIBE']),
  ('equities-writer', 'TOPIC', 'equities-', ['WRITE', 'DESCRIBE', 'DESCRIBE_CONFIGS']),
  ('equities-reader', 'TOPIC', 'equities-', ['READ', 'DESCRIBE', 'DESCRIBE_CONFIGS']),
  ('equities-reader', 'GROUP', 'equities-', ['READ', 'DESCRIBE']),
  ('fi-manager', 'TOPIC', 'fi-', NULL), ('fi-manager', 'GROUP', 'fi-', NULL), ('fi-manager', 'CLUSTER', '', ['CREATE', 'DESCRIBE']),
  ('fi-writer', 'TOPIC', 'fi-', ['WRITE', 'DESCRIBE', 'DESCRIBE_CONFIGS']),
  ('fi-reader', 'TOPIC', 'fi-', ['READ', 'DESCRIBE', 'DESCRIBE_CONFIGS']), ('fi-reader', 'GROUP', 'fi-', ['READ', 'DESCRIBE'])
),
granted AS (
  SELECT *, EXISTS (SELECT 1 FROM binding g WHERE g.usr = r.usr AND g.type = r.resource_type AND starts_with(r.resource, g.prefix)
    AND (g.ops IS NULL OR list_contains(g.ops, r.operation))) AS granted
  FROM decided r
)"""

RECORDS = EV + """,
rec AS (
  SELECT event_id AS seq, k, value, ts_ms, user_id, event_type,
    list_filter([
      CASE WHEN k = 24 THEN 'paymentId/type' END,
      CASE WHEN k = 26 THEN 'sourceAccountIban/missing' END,
      CASE WHEN k = 21 THEN 'destAccountIban/missing' END,
      CASE WHEN k = 22 THEN 'amount/type' END,
      CASE WHEN k % 30 = 2 THEN 'currency/missing' END,
      CASE WHEN k = 23 THEN 'timestamp/type' END], lambda x: x IS NOT NULL) AS bad,
    list_filter([
      CASE WHEN k = 24 THEN 'paymentId/type' END,
      CASE WHEN k = 26 THEN 'sourceAccountIban/missing' END,
      CASE WHEN k = 21 THEN 'destAccountIban/missing' END,
      CASE WHEN k <> 22 THEN 'amount/type' END,
      CASE WHEN k % 30 = 2 THEN 'currency/missing' END,
      CASE WHEN k = 23 THEN 'timestamp/type' END,
      'mandatoryAuditCode/missing'], lambda x: x IS NOT NULL) AS bad_breaking
  FROM ev
),
whole AS (
  SELECT * REPLACE (CASE WHEN k = 25 THEN ['*/malformed'] ELSE bad END AS bad,
    CASE WHEN k = 25 THEN ['*/malformed'] ELSE bad_breaking END AS bad_breaking) FROM rec
)"""

EQUITY = """
orders_json AS (
  SELECT *, list_filter([
    CASE WHEN l_quantity = 13 THEN 'shares/missing' WHEN l_quantity = 17 THEN 'shares/type' END,
    CASE WHEN l_quantity = 19 THEN 'side/type' END], lambda x: x IS NOT NULL) AS bad
  FROM lineitem
)"""

_PROBLEM = "split_part(v, '/', 1) AS field, split_part(v, '/', 2) AS problem"


def _w(ctes: str, select: str) -> str:
    head = ctes if ctes.lstrip().startswith("WITH") else "WITH " + ctes
    return f"{head}\n{select}"


_CHANGE_COLUMNS = f"""alert_id, key AS dedup_key, alert_name, service, env AS environment, state AS current_state,
  prev_state AS previous_state, transition, priority AS effective_priority, state = 'FLAPPING' AND status = 'FIRING' AS flapping,
  false AS suppressed, n AS occurrence_count, {iso('ms')} AS timestamp, ms AS timestamp_epoch_ms, rid AS resource_id, seq, alert_pos"""

ORACLES = {
    "normalized_events": _w(CANON, f"""SELECT event_id, 'grafana' AS source, 'ALERT' AS event_type, alert_name,
      coalesce(fp, {_UUID}) AS fingerprint, status, severity AS source_severity, stamp AS event_timestamp, ms AS timestamp_epoch_ms,
      service, env AS environment, true AS testing, 'event ' || seq AS summary, seq, alert_pos FROM canon"""),
    "dedup_key": _w(CANON, """SELECT key AS deduplication_key, count(*) AS events, min(ms) AS first_ms, max(ms) AS last_ms
      FROM canon GROUP BY key"""),
    "resource_mapping": _w(CANON, """SELECT seq, alert_pos, rid AS resource_id,
      CASE b WHEN 0 THEN 'instance' WHEN 1 THEN 'server' WHEN 2 THEN 'server' WHEN 3 THEN 'pod' ELSE 'infrastructure' END AS resource_type,
      CASE WHEN b = 0 THEN rid END AS resource_instance FROM canon"""),
    "dead_letters": _w(EV, """SELECT 'events-0-' || event_id AS source_id, event_id AS seq,
      CASE k WHEN 14 THEN 'Malformed webhook payload' WHEN 15 THEN 'Null alert in payload'
        ELSE 'Empty or null alerts array in payload' END AS error FROM ev WHERE k IN (13, 14, 15, 63)"""),
    "enriched_events": _w(CANON, """SELECT seq, alert_pos, priority AS effective_priority, priority AS published_priority,
      env AS enriched_environment, 'true' AS enriched_testing, '1.0-prod' AS pipeline_version, CAST(5 AS BIGINT) AS annotations FROM canon"""),
    "priority_matrix": _w(CANON, """SELECT env AS environment, severity AS source_severity, priority AS effective_priority,
      count(*) AS events FROM canon GROUP BY ALL"""),
    "alert_groups": _w(DEDUP, """SELECT group_id, key AS dedup_key, alert_name, service, group_env AS environment, status,
      n AS occurrence_count, first_stamp AS first_seen, stamp AS last_seen, first_ms AS first_seen_epoch_ms,
      ms AS last_seen_epoch_ms, rid AS impacted_resources, event_id AS latest_event_id, seq, alert_pos FROM grouped JOIN hashed USING (key)"""),
    "alert_groups_latest": _w(DEDUP, f"""SELECT key AS dedup_key, group_id, status, n AS occurrence_count,
      first_ms AS first_seen_epoch_ms, ms AS last_seen_epoch_ms, event_id AS latest_event_id
      FROM {_NUMBERED.format('key', 'grouped')} JOIN hashed USING (key) WHERE back = 1"""),
    "unique_alerts": _w(DEDUP, """SELECT key AS deduplication_key, event_id, status, ms AS event_ms, seq, alert_pos
      FROM cycled WHERE is_new"""),
    "group_id_hash": _w(DEDUP, """SELECT group_id, min(key) AS dedup_key, count(*) AS updates FROM canon JOIN hashed USING (key) GROUP BY group_id"""),
    "state_changes": _w(LIFE, f"SELECT {_CHANGE_COLUMNS} FROM changes"),
    "transition_counts": _w(LIFE, """SELECT prev_state AS previous_state, state AS current_state, transition, count(*) AS changes
      FROM changes GROUP BY ALL"""),
    "transition_history": _w(LIFE, """SELECT alert_id, key AS dedup_key, prev_state AS previous_state, state AS current_state, transition,
      ms AS event_ms, seq, alert_pos FROM changes WHERE alert_name = 'DatabaseConnectionTimeout' ORDER BY ms, seq, alert_pos"""),
    "reopened": _w(LIFE, """SELECT key AS dedup_key, identity AS identity_ms, min(alert_id) AS alert_id, count(*) AS times_reopened,
      count(DISTINCT alert_id) = 1 AS same_alert_id FROM changes WHERE transition = 'REOPENED' GROUP BY key, identity"""),
    "flapping": _w(LIFE, """SELECT alert_id, key AS dedup_key, transition, state AS current_state, ms AS timestamp_epoch_ms, seq, alert_pos
      FROM changes WHERE state = 'FLAPPING'"""),
    "incident_changes": _w(INCIDENTS, f"""SELECT incident_id, title, 'OPEN' AS status, inc_priority AS priority, service,
      inc_env AS environment, root_id AS root_cause_alert_id, root_name AS root_cause_alert_name, member_count,
      'service-temporal-fault-tree' AS correlation_rule, {iso('created')} AS created_at, {iso('updated')} AS updated_at,
      created AS created_at_epoch_ms, updated AS updated_at_epoch_ms, seq, alert_pos FROM incidents"""),
    "incident_members": _w(INCIDENTS + """,
final AS (
  SELECT incident_id, service, created, max_by(ids, i) AS ids, max_by(names, i) AS names FROM incidents GROUP BY ALL
),
joined AS (SELECT incident_id, member_count AS member_no, min(ms) AS joined_ms FROM incidents GROUP BY ALL),
listed AS (
  SELECT incident_id, service, created, unnest(ids) AS alert_id, unnest(names) AS alert_name,
    CAST(unnest(range(1, len(ids) + 1)) AS BIGINT) AS member_no FROM final
)""", """SELECT incident_id, service, created AS created_at_epoch_ms, member_no, alert_id, alert_name,
      joined_ms AS joined_epoch_ms FROM listed JOIN joined USING (incident_id, member_no)"""),
    "incidents_latest": _w(INCIDENTS, """SELECT incident_id, service, inc_priority AS priority, title, root_id AS root_cause_alert_id,
      root_name AS root_cause_alert_name, member_count, created AS created_at_epoch_ms, updated AS updated_at_epoch_ms
      FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY i DESC) AS back FROM incidents) WHERE back = 1"""),
    "latest_incident_per_service": _w(INCIDENTS, """SELECT service, incident_id, inc_priority AS priority, title,
      root_name AS root_cause_alert_name, member_count
      FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY i DESC) AS back FROM incidents) WHERE back = 1"""),
    "root_cause": _w(INCIDENTS, """SELECT service, root_name AS root_cause_alert_name, inc_priority AS priority, count(*) AS updates
      FROM incidents GROUP BY ALL"""),
    "incident_records": _w(INCIDENTS, """SELECT incident_id, array_to_string(ids, ',') AS correlated_alert_ids,
      array_to_string(names, ',') AS correlated_alert_names, seq, alert_pos FROM incidents"""),
    "result_bundle": _w(INCIDENTS, """SELECT 'alert-groups' AS topic, group_id AS id, alert_name AS name, count(*) AS records
        FROM grouped JOIN hashed USING (key) GROUP BY ALL
      UNION ALL SELECT 'alerts.state-changes', alert_id, alert_name, count(*) FROM changes GROUP BY ALL
      UNION ALL SELECT 'incidents.state-changes', incident_id, title, count(*) FROM incidents GROUP BY ALL"""),
    "latest_group_per_alert": _w(DEDUP, f"""SELECT alert_name, group_id, n AS occurrence_count, first_stamp AS first_seen, stamp AS last_seen
      FROM {_NUMBERED.format('alert_name', 'grouped')} JOIN hashed USING (key) WHERE back = 1"""),
    "cdc_unwrap": _w(PAY, """SELECT topic, tx AS transaction_id, acct AS account_id, amount, cur AS currency, ms AS event_ms, seq FROM good"""),
    "rejected_payments": _w(PAY, "SELECT topic, seq, rejected FROM pay WHERE rejected IS NOT NULL"),
    "velocity": _w(PAY, """SELECT tx AS transaction_id, acct AS account_id, ms AS event_ms, seq, window_count FROM counted"""),
    "high_value": _w(PAY, """SELECT tx AS transaction_id, acct AS account_id, amount, cur AS currency, topic FROM good WHERE amount >= 10000 AND NOT isnan(amount)"""),
    "fraud_alerts": _w(FRAUD, """SELECT alert_id, tx AS transaction_id, acct AS account_id, amount, cur AS currency, rule AS alert_type,
      severity, stamp AS timestamp, details, topic AS source_topic FROM alerts"""),
    "audit_union": _w(FRAUD + MESSAGES + """,
lines AS (
  SELECT topic, value FROM messages
  UNION ALL
  SELECT 'fraud-alerts', '{"alertId":"' || alert_id || '","transactionId":"' || tx || '","accountId":"' || acct || '","amount":' || CASE WHEN isnan(amount) THEN '"NaN"' ELSE CAST(amount AS VARCHAR) END
    || ',"currency":"' || cur || '","alertType":"' || rule || '","severity":"' || severity || '","timestamp":"' || stamp
    || '","details":"' || details || '","sourceTopic":"' || topic || '"}'
  FROM alerts
)""", "SELECT topic, value, count(*) AS copies FROM lines GROUP BY ALL"),
    "topic_dump": _w(PAY + MESSAGES, """SELECT topic, count(*) AS records, CAST(sum(length(value)) AS BIGINT) AS characters
      FROM messages WHERE value LIKE '{%' GROUP BY topic"""),
    "current_ledger": _w(EV, """SELECT 'U-' || user_id AS transaction_id, 'ACC-' || (user_id % 25) AS account_id, value AS amount,
      'EUR' AS currency, event_type AS status, ts_ms AS changed_ms
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS back FROM ev)
      WHERE back = 1 AND event_type <> 'error'"""),
    "perf_log_parse": _w(PERF, """SELECT run_id, topic, sent AS records_sent, value AS records_per_sec, k + 0.25::DOUBLE AS mb_per_sec,
      value AS avg_latency_ms, CAST(k * 10 AS DOUBLE) AS max_latency_ms, CAST(k AS DOUBLE) AS p50_latency_ms,
      CAST(k + 5 AS DOUBLE) AS p95_latency_ms, CAST(k + 9 AS DOUBLE) AS p99_latency_ms FROM perf"""),
    "consumer_csv_parse": _w(EV, """SELECT event_id AS run_id, event_type AS topic, value AS data_consumed_mb, value AS mb_per_sec,
      k * 100 AS records_consumed, value AS records_per_sec, CAST(k AS DOUBLE) AS rebalance_time_ms,
      CAST(k + 10 AS DOUBLE) AS fetch_time_ms, value AS fetch_mb_per_sec, value AS fetch_records_per_sec FROM ev WHERE k <> 8"""),
    "throughput_totals": _w(PERF, """SELECT CAST(sum(sent) AS BIGINT) AS records_sent, CAST(sum(failed) AS BIGINT) AS failed_records,
      (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE AS duration_sec,
      round(sum(sent) / ((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE), 1) AS records_per_sec,
      round(sum(sent) * 512 / 1048576.0::DOUBLE / ((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE), 2) AS mb_per_sec,
      round(sum(sent) * 512 / 1048576.0::DOUBLE, 6) AS total_mb FROM perf"""),
    "throughput_by_topic": _w(PERF, """SELECT topic, CAST(sum(sent) AS BIGINT) AS records_sent, CAST(sum(failed) AS BIGINT) AS failed_records,
      round(sum(sent) / ((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE), 1) AS records_per_sec,
      round(sum(sent) * 512 / 1048576.0::DOUBLE / ((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE), 2) AS mb_per_sec FROM perf GROUP BY topic"""),
    "peak_topic": _w(PERF, """SELECT topic AS peak_topic, value AS peak_rate FROM perf ORDER BY value DESC, topic DESC LIMIT 1"""),
    "partition_delta": _w(OFFSETS, "SELECT topic, part AS partition, records FROM delta"),
    "partition_balance": _w(OFFSETS, """SELECT topic, part AS partition, records, CAST(sum(records) OVER t AS BIGINT) AS topic_records,
      round(records / (sum(records) OVER t)::DOUBLE, 6) AS share,
      round(records / (sum(records) OVER t)::DOUBLE - 1.0::DOUBLE / count(*) OVER t, 6) AS deviation,
      round(var_pop(records) OVER t, 4) AS variance FROM delta WINDOW t AS (PARTITION BY topic)"""),
    "latency_percentiles": _w(EV, """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50,
      round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev GROUP BY event_type"""),
    "reconcile_targets": _w(EV + """,
j AS (SELECT event_type AS topic, CAST(sum(k * 100) AS BIGINT) AS target, CAST(coalesce(sum(k * 100) FILTER (k <> 7), 0) AS BIGINT) AS sent,
  CAST(coalesce(sum(k * 100) FILTER (k <> 8), 0) AS BIGINT) AS got FROM ev GROUP BY 1)""",
        """SELECT topic, target AS target_records, sent AS records_sent, got AS records_consumed, greatest(target - sent, 0) AS unsent,
      greatest(sent - target, 0) AS surplus, greatest(sent - got, 0) AS unconsumed, target * 512 AS planned_bytes FROM j"""),
    "access_decisions": _w(REQ, """SELECT request_id, principal, operation, resource, resource_type, internal_rule, admin_rule,
      manager_rule, cluster_rule, writer_rule, reader_rule, group_rule, allowed FROM decided"""),
    "principal_teams": _w(REQ, """SELECT request_id, principal, 'manager' AS role, mteam AS team FROM req WHERE mteam IS NOT NULL
      UNION ALL SELECT request_id, principal, 'writer', wteam FROM req WHERE wteam IS NOT NULL
      UNION ALL SELECT request_id, principal, 'reader', rteam FROM req WHERE rteam IS NOT NULL"""),
    "access_rollup": _w(REQ, """SELECT principal, CASE WHEN lower(resource) LIKE 'team-%' THEN substr(lower(resource), 1, 6)
        ELSE split_part(resource, '-', 1) END AS team, resource,
      count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS denied FROM decided GROUP BY ALL"""),
    "acl_semi_join": _w(REQ, "SELECT request_id, principal, operation, resource, resource_type FROM granted WHERE granted"),
    "decision_report": _w(REQ, """SELECT granted AS expected, allowed, count(*) FILTER (allowed = granted) AS passed,
      count(*) FILTER (allowed <> granted) AS failed FROM granted GROUP BY ALL"""),
    "contract_v1_good": _w(RECORDS, """SELECT seq, 'PAY-' || seq AS "paymentId", 'IBAN-' || user_id AS "sourceAccountIban",
      'IBAN-DEST' AS "destAccountIban", value AS amount, 'EUR' AS currency, ts_ms AS timestamp FROM whole WHERE len(bad) = 0"""),
    "contract_violations": _w(RECORDS, f"""SELECT seq, {_PROBLEM} FROM (SELECT seq, unnest(bad) AS v FROM whole)"""),
    "contract_v2_read": _w(RECORDS, """SELECT seq, 'PAY-' || seq AS "paymentId", value AS amount,
      CASE WHEN event_type = 'purchase' THEN 'invoice ' || k END AS "remittanceInfo",
      CASE WHEN event_type = 'purchase' THEN k / 100.0::DOUBLE END AS "fraudRiskScore" FROM whole WHERE len(bad) = 0"""),
    "breaking_change_impact": _w(RECORDS, f"""SELECT {_PROBLEM}, count(*) AS records
      FROM (SELECT unnest(bad_breaking) AS v FROM whole) GROUP BY ALL"""),
    "equity_order_violations": _w(EQUITY, f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_PROBLEM}
      FROM (SELECT l_orderkey, l_linenumber, unnest(bad) AS v FROM orders_json)"""),
    "equity_orders_good": _w(EQUITY, """SELECT 'SYM-' || l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
      count(*) AS orders, CAST(sum(l_quantity) AS BIGINT) AS shares, round(sum(l_extendedprice), 2) AS notional
      FROM orders_json WHERE len(bad) = 0 GROUP BY ALL"""),
    "contract_versions": _w(EV, """SELECT 'banking-payments-value' AS subject,
      count(DISTINCT event_type = 'purchase') AS versions, CAST(max(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) AS BIGINT) AS latest_version,
      count(*) AS records FROM ev"""),
}

_WEIGHT = """CASE WHEN regexp_matches(lower(alert_name), 'database|disk|storage|network') THEN 100
  WHEN regexp_matches(lower(alert_name), 'pod|container|memory|oom') THEN 50
  WHEN regexp_matches(lower(alert_name), 'http|ingress|gateway|latency') THEN 20 ELSE 0 END"""
_RANK = """CASE WHEN alert_name IN ('DatabaseConnectionTimeout', 'DiskSpaceLow', 'StorageFailure') THEN 1
  WHEN alert_name IN ('NetworkInterfaceDrop', 'DNSResolutionFailure') THEN 2
  WHEN alert_name IN ('HighHTTP5xxErrorRate', 'GatewayTimeout') THEN 3
  WHEN alert_name IN ('PodCrashLoopBackOff', 'MemoryLeakDetected', 'HighCPUUsage') THEN 4 ELSE 5 END"""

# Rows of accepted state changes, each with its alert.
_ACCEPTED = INCIDENTS + """,
accepted AS (SELECT n.*, q.alert_id, q.alert_name, q.priority AS own_priority FROM incidents n JOIN queue q USING (service, i)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY i DESC) AS back FROM accepted) WHERE back = 1)"""

_ITEMS = """
items AS (
  SELECT 'app-' || s_suppkey AS ci, 'host-' || s_nationkey AS parent, s_name AS ci_name FROM supplier
  UNION ALL SELECT 'host-' || n_nationkey, 'zone-' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'zone-' || r_regionkey, NULL, r_name FROM region
)"""
_TOPS = _ITEMS + """,
climb AS (
  SELECT ci, ci AS reached, 0 AS depth FROM items
  UNION ALL SELECT c.ci, i.parent, depth + 1 FROM climb c JOIN items i ON i.ci = c.reached WHERE i.parent IS NOT NULL
),
tops AS (SELECT ci, arg_max(reached, depth) AS top FROM climb GROUP BY ci)"""

ORACLES.update({
    "count_threshold": _w(CANON + """,
ranged AS (
  SELECT key, ms, seq, alert_pos, count(*) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 119999 PRECEDING AND CURRENT ROW) AS in_range,
    count(*) OVER (PARTITION BY key, ms) AS same, row_number() OVER (PARTITION BY key, ms ORDER BY seq, alert_pos) AS nth FROM canon
)""", """SELECT key AS deduplication_key, ms AS event_ms, in_range - (same - nth) AS window_count, seq, alert_pos
      FROM ranged WHERE in_range - (same - nth) > 5"""),
    "tag_clusters": _w(CANON + """,
tagged AS (
  SELECT *, CASE WHEN b < 2 THEN 'prod-us-east-1' ELSE 'default' END || ':' || CASE WHEN b = 2 THEN 'payments' ELSE 'default' END
    || ':' || CASE WHEN b = 4 THEN 'default' ELSE service END AS ck FROM canon
),
ranged AS (SELECT *, count(*) OVER (PARTITION BY ck ORDER BY ms RANGE BETWEEN 899999 PRECEDING AND CURRENT ROW) AS in_range,
  count(*) OVER (PARTITION BY ck, ms) AS same, row_number() OVER (PARTITION BY ck, ms ORDER BY seq, alert_pos) AS nth FROM tagged),
dense AS (SELECT *, in_range - (same - nth) AS together, in_range - (same - nth) >= 15 AS d FROM ranged),
begun AS (SELECT *, d AND NOT coalesce(lag(d) OVER (PARTITION BY ck ORDER BY ms, seq, alert_pos), false) AS begins FROM dense),
grouped_up AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY ck ORDER BY ms, seq, alert_pos) AS g FROM begun)""",
        """SELECT ck AS cluster_key, CAST(g AS BIGINT) AS group_no, min(ms) AS reached_ms, max(ms) AS last_ms, count(*) AS alerts,
      max(together) AS most_together, array_to_string(list_sort(list_distinct(list(alert_name))), ',') AS alert_names
      FROM grouped_up WHERE d GROUP BY ck, g"""),
    "ci_binding": _w(CANON + "," + _ITEMS, """SELECT seq, alert_pos, ci, ci_name, parent AS ci_parent
      FROM canon LEFT JOIN items ON ci = rid"""),
    "maintenance_tags": _w(CANON, """SELECT seq, alert_pos, EXISTS (SELECT 1 FROM ev w WHERE w.event_type = 'signup'
      AND 'host-' || w.b = c.rid AND c.ms >= w.ts_ms AND c.ms < w.ts_ms + w.k * 60000) AS maintenance FROM canon c"""),
    "topmost_items": "WITH RECURSIVE " + _TOPS + " SELECT ci, top FROM tops",
    "topology_groups": "WITH RECURSIVE " + CANON + "," + _TOPS + """
      SELECT top, count(*) AS events, count(DISTINCT key) AS alert_keys, min(ms) AS first_ms, max(ms) AS last_ms
      FROM canon JOIN tops ON ci = rid GROUP BY top""",
    "weighted_root_cause": _w(_ACCEPTED + f""",
weighed AS (SELECT *, {_WEIGHT} AS w FROM accepted),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY w DESC, i) AS r FROM weighed) WHERE r = 1)""",
        """SELECT best.service, best.created AS created_at_epoch_ms, best.alert_id AS root_cause_alert_id,
      best.alert_name AS root_cause_alert_name, CAST(w AS BIGINT) AS weight,
      CASE WHEN w = 100 THEN 'P1' ELSE last.inc_priority END AS priority FROM best JOIN last USING (incident_id)"""),
    "weighted_root_election": _w(_ACCEPTED + f""",
weighed AS (SELECT *, {_WEIGHT} AS w FROM accepted)""",
        """SELECT service, created AS created_at_epoch_ms, seq, alert_pos,
      arg_max(alert_id, CAST(w AS BIGINT) * 1000000000 - i) OVER so_far AS root_cause_alert_id,
      arg_max(alert_name, CAST(w AS BIGINT) * 1000000000 - i) OVER so_far AS root_cause_alert_name,
      CAST(max(w) OVER so_far AS BIGINT) AS weight,
      CASE WHEN max(w) OVER so_far = 100 THEN 'P1' ELSE inc_priority END AS priority
      FROM weighed WINDOW so_far AS (PARTITION BY incident_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""),
    "ranked_root_cause": _w(_ACCEPTED + f""",
ranked AS (SELECT *, {_RANK} AS rk, min(own_priority) OVER (PARTITION BY incident_id) AS top_priority FROM accepted),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY rk, i) AS r FROM ranked) WHERE r = 1)""",
        """SELECT service, created AS created_at_epoch_ms, alert_id AS root_cause_alert_id, alert_name AS root_cause_alert_name,
      CAST(rk AS BIGINT) AS cause_rank, top_priority AS priority FROM best"""),
    "child_suppression": _w(_ACCEPTED + """,
listed AS (SELECT incident_id, root_id, unnest(ids) AS alert_id, unnest(names) AS alert_name FROM last)""",
        """SELECT alert_id, alert_name, alert_id <> root_id AS is_secondary, incident_id AS parent_incident_id,
      alert_id <> root_id AS suppress_notification FROM listed"""),
    "remediation_commands": _w(_ACCEPTED, """SELECT 'KUBERNETES_RESTART_POD' AS action, r.rid AS target, l.incident_id,
      l.root_id AS root_cause_alert_id FROM last l JOIN (SELECT DISTINCT alert_id, service, rid FROM queue) r
      ON r.alert_id = l.root_id AND r.service = l.service WHERE l.root_name = 'PodCrashLoopBackOff'"""),
    "expired_alerts": _w(LIFE + """,
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS back FROM changes) WHERE back = 1),
aged AS (SELECT *, (SELECT max(ts_ms) + 1166400000 FROM ev) - ms AS age FROM newest)""",
        """SELECT key AS dedup_key, alert_id, state AS current_state, ms AS last_ms,
      CASE WHEN age > 1209600000 THEN 'CLOSED' ELSE 'EXPIRED' END AS verdict FROM aged
      WHERE age > 1209600000 OR (state = 'RESOLVED' AND age > 86400000)"""),
    "late_events": _w(EV + """,
arrived AS (SELECT 'lane-' || b AS lane, event_id AS seq, ts_ms AS ms, ts_ms + CASE WHEN k = 50 THEN 60000 ELSE 0 END AS arrival FROM ev),
peaked AS (SELECT *, max(ms) OVER (PARTITION BY lane ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM arrived)""",
        "SELECT lane, seq, ms AS event_ms, newest AS newest_ms FROM peaked WHERE ms < newest - 10000"),
    "tickets": _w(_ACCEPTED, """SELECT incident_id AS correlation_id, title AS short_description, inc_priority AS severity, service AS cmdb_ci,
      '["' || array_to_string(names, '","') || '"]' AS work_notes FROM last"""),
    "incident_feedback": _w(_ACCEPTED + """,
reached AS (SELECT incident_id, member_count, min(ms) AS ms FROM accepted WHERE member_count IN (2, 5) GROUP BY ALL),
news AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ms DESC, member_count DESC) AS back FROM reached)""",
        """SELECT last.incident_id, CASE news.member_count WHEN 2 THEN 'In Progress' WHEN 5 THEN 'Resolved' ELSE 'OPEN' END AS state,
      CASE WHEN news.member_count IS NOT NULL THEN 'alice' END AS assigned_to, coalesce(news.ms, last.created) AS status_ms
      FROM last LEFT JOIN news ON news.incident_id = last.incident_id AND news.back = 1"""),
    "environment_matrix": _w(CANON, """SELECT env AS environment, severity AS source_severity,
      CASE WHEN env = 'prod' THEN CASE WHEN severity = 'CRITICAL' THEN 'P1' WHEN severity IN ('HIGH', 'WARNING') THEN 'P2' ELSE 'P3' END
        ELSE CASE WHEN severity = 'CRITICAL' THEN 'P2' WHEN severity IN ('HIGH', 'WARNING') THEN 'P3' ELSE 'P4' END END AS priority,
      count(*) AS events FROM canon GROUP BY ALL"""),
    "quiet_flaps": _w(LIFE + """,
ahead AS (SELECT *, coalesce(lead(ms) OVER (PARTITION BY key ORDER BY n), (SELECT max(ts_ms) FROM ev)) AS next_ms FROM changes)""",
        """SELECT key AS dedup_key, alert_id, ms + 600000 AS cleared_ms FROM ahead WHERE state = 'FLAPPING' AND next_ms - ms > 600000"""),
    "closed_cycles": _w(DEDUP, """SELECT key AS dedup_key, first_ms AS first_seen_epoch_ms, count(*) AS occurrences,
      max(ms) AS last_seen_epoch_ms, max(ms) + 300000 AS closed_ms FROM grouped GROUP BY key, cycle, first_ms"""),
    "scattered_withdrawals": _w(EV + """,
high AS (SELECT 'ACC-' || (user_id % 25) AS acct, k % 10 AS place, event_id AS seq, ts_ms // 10 AS ms FROM ev WHERE round(value * 2000) >= 10000),
numbered AS (SELECT *, row_number() OVER (PARTITION BY acct ORDER BY ms, seq) AS n,
  row_number() OVER (PARTITION BY acct ORDER BY ms, seq) - count(*) OVER (PARTITION BY acct ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW)
    + count(*) OVER (PARTITION BY acct, ms) - row_number() OVER (PARTITION BY acct, ms ORDER BY seq) AS gone FROM high),
listed AS (SELECT acct, seq, ms, n, gone, list(place) OVER (PARTITION BY acct ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS places FROM numbered)""",
        """SELECT acct AS account_id, seq, ms AS event_ms, CAST(len(list_distinct(places[gone + 1 : n])) AS BIGINT) AS places
      FROM listed WHERE len(list_distinct(places[gone + 1 : n])) > 3"""),
    "noise_reduction": _w(_ACCEPTED + """,
received AS (SELECT service, count(*) AS events FROM canon GROUP BY service),
sent AS (SELECT service, count(*) AS n, avg(updated - created) AS open_ms FROM last GROUP BY service)""",
        """SELECT service, events, coalesce(n, 0) AS notifications, round(1 - coalesce(n, 0) / events::DOUBLE, 6) AS noise_reduction,
      round(open_ms, 3) AS mean_open_ms FROM received LEFT JOIN sent USING (service)"""),
    "detection_delay": _w(_ACCEPTED, """SELECT service, count(*) AS n, quantile_cont((updated - created)::DOUBLE, 0.5) AS p50,
      quantile_cont((updated - created)::DOUBLE, 0.95) AS p95 FROM last GROUP BY service"""),
})
