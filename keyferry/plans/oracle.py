"""DuckDB SQL that gives the same rows as the registered queries."""

ORACLE: dict[str, str] = {}

# --- the views, in SQL

SOURCE_COLUMNS = """
  'order:' || o_orderkey AS key, 'string' AS type,
  concat_ws('|', o_custkey, o_orderstatus, o_orderpriority) AS value,
  CASE WHEN o_orderkey % 5 = 0 THEN 3600 ELSE -1 END::BIGINT AS ttl_s, (o_orderkey % 3)::INT AS node
"""
V = {
    "src": f"SELECT {SOURCE_COLUMNS} FROM orders",
    "tgt": f"""
      SELECT key, type, value || CASE WHEN o_orderkey % 17 = 0 THEN '|stale' ELSE '' END AS value, ttl_s, node
      FROM (SELECT o_orderkey, {SOURCE_COLUMNS} FROM orders WHERE o_orderkey % 10 <> 3)
      UNION ALL
      SELECT 'ghost:' || c_custkey, 'string', 'x', -1::BIGINT, 0 FROM customer WHERE c_custkey % 50 = 0""",
    "known": f"SELECT {SOURCE_COLUMNS} FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'",
    "raw": """
      SELECT 'li:{' || l_orderkey || '}:' || l_linenumber AS key, 'string' AS type,
        concat_ws('|', l_partkey, l_suppkey, l_returnflag) AS value, -1::BIGINT AS ttl_s, (l_suppkey % 3)::INT AS node
      FROM lineitem""",
    "listed": "SELECT 'order:' || l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R'",
    "docs": "SELECT 'doc:' || doc_id AS key, 'string' AS type, text AS value, doc_id FROM documents",
    "chg": """
      SELECT 'node-' || user_id % 3 AS node_id, 'user:' || user_id AS key,
        CASE event_type WHEN 'view' THEN 'expire' WHEN 'error' THEN 'del' ELSE 'set' END AS op,
        CASE WHEN event_type IN ('signup', 'click', 'purchase') THEN props END AS value,
        CASE WHEN event_type = 'view' THEN 60 + event_id % 100 END::BIGINT AS ttl_s, ts, event_id AS "offset"
      FROM events""",
    "users": """
      SELECT 'user:' || c_custkey AS key, 'string' AS type, c_name AS value, -1::BIGINT AS ttl_s,
        c_nationkey::INT AS node FROM customer""",
    "logs": """
      SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0')
          AS timestamp,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
          WHEN 'view' THEN 'INFO' ELSE 'DEBUG' END AS level,
        event_type AS message, 'sync.go:' || user_id AS source, md5(event_id::VARCHAR) AS request_id,
        'task-' || user_id % 7 AS task_id, props AS fields,
        CASE WHEN event_type = 'error' THEN 'at sync.go:' || user_id END AS stack
      FROM events""",
    "metric": """
      SELECT 'task-' || user_id % 7 AS task_id, event_type AS metric_name, value AS metric_value,
        epoch_us(ts) // 1000000 AS timestamp FROM events""",
    "prog": """
      SELECT 'task-' || user_id % 7 AS task_id, 'worker-' || user_id % 4 AS worker_id, 1::BIGINT AS keys_processed,
        strlen(props)::BIGINT AS bytes_sent, (event_type = 'error')::BIGINT AS error_count, ts FROM events""",
    "conv": """
      SELECT 'task-' || task AS task_id, iteration::INT AS iteration,
        n + CASE task WHEN 0 THEN 0 WHEN 3 THEN 2000 ELSE 1000 END AS change_count,
        CASE task WHEN 1 THEN 10000000 ELSE 100000 END::BIGINT AS total_keys,
        CASE task WHEN 3 THEN TIMESTAMP '2024-01-01' + to_minutes(iteration) ELSE day::TIMESTAMP END AS ts
      FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY day) AS iteration
            FROM (SELECT user_id % 4 AS task, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL))""",
    "ckpt": """
      SELECT 'task-' || l_suppkey % 3 AS task_id, 'worker-' || l_suppkey % 4 AS worker_id,
        (l_partkey % 16384)::INT AS slot_id, CASE WHEN l_returnflag = 'A' THEN '0' ELSE l_orderkey::VARCHAR END AS cursor,
        floor(l_quantity)::BIGINT AS keys_migrated, floor(l_extendedprice)::BIGINT AS bytes_migrated,
        concat_ws(':', l_orderkey, l_linenumber) AS last_key, epoch_us(l_shipdate) // 1000000 AS updated_at,
        l_orderkey * 10 + l_linenumber AS seq
      FROM lineitem""",
    "att": """
      SELECT 'task-' || l_orderkey % 7 AS task_id, 'order:' || l_orderkey AS key, l_linenumber AS attempt,
        CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'skipped' ELSE 'failed' END AS outcome
      FROM lineitem""",
    "runs": """
      SELECT 'task-' || c_custkey AS id, c_name AS name,
        ['pending', 'running', 'paused', 'completed', 'failed'][c_custkey % 5 + 1] AS status,
        1700000000 + 60 * c_custkey AS created_at
      FROM customer""",
    "counters": """
      SELECT 'task-' || o_custkey AS task_id, 1700000000 + o_custkey AS started_at, 5000 * count(*) AS keys_total,
        5000 * count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'F') AS keys_migrated,
        5000 * count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'O') AS keys_skipped,
        5000 * count(*) FILTER (o_orderpriority = '5-LOW') AS keys_filtered
      FROM orders GROUP BY o_custkey""",
    "stats": """
      SELECT 'task-' || o_custkey AS task_id, count(*) AS total_keys,
        count(*) FILTER (o_orderstatus = 'F') AS migrated_keys, sum(size)::BIGINT AS total_bytes,
        coalesce(sum(size) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS migrated_bytes,
        count(*) FILTER (o_orderstatus = 'P') AS error_count
      FROM (SELECT *, length(concat_ws('|', o_custkey, o_orderstatus, o_orderpriority)) AS size FROM orders)
      GROUP BY o_custkey""",
    "batches": """
      SELECT o_orderkey AS id, 'task-' || o_custkey AS task_id, 'batch-' || o_orderkey AS batch_id, 100 AS total_keys,
        (o_orderkey % 101)::INT AS matched_keys, (100 - o_orderkey % 101)::INT AS mismatched_keys, 0 AS missing_keys,
        epoch_us(o_orderdate) // 1000000 AS created_at
      FROM orders""",
    "reports": """
      SELECT s_nationkey::VARCHAR AS cluster, lpad(s_suppkey::VARCHAR, 8, '0') AS node, 1000 + s_suppkey * 37 % 5000 AS keys,
        CASE WHEN s_suppkey % 11 = 0 THEN 300 ELSE 10000 END AS maxclients,
        concat_ws(chr(13) || chr(10), '# Server',
          CASE WHEN s_suppkey % 13 <> 0 THEN 'redis_version:6.2.' || s_suppkey % 5 END, 'os:Linux',
          '# Clients', 'connected_clients:' || 10 + s_suppkey * 13 % 90, '', '# Memory',
          'used_memory:' || CASE WHEN s_suppkey % 17 = 0 THEN 'n/a' ELSE ((1000 + s_suppkey * 37 % 5000)
            * [300, 5000, 50000, 500000, 2000000][s_nationkey % 5 + 1])::VARCHAR END,
          'used_memory_human:1M', 'maxmemory:' || (1 + s_suppkey % 4) * 1073741824, '# Stats',
          'instantaneous_ops_per_sec:' || [5, 120, 1500, 40000][s_nationkey % 4 + 1] + s_suppkey % 3) AS info
      FROM supplier""",
}


def define(name: str, views: str, sql: str) -> None:
    """Register the SQL of a query; ``views`` names the views it reads, in order of definition."""
    parts = [f"{view} AS ({V[view]})" for view in views.split()]
    ORACLE[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql


def derive(view: str, sql: str) -> None:
    V[view] = sql


def slot_of(key: str) -> str:
    """CRC16/XMODEM slot of an ASCII key, byte by byte with shifts only."""
    tag = (
        rf"CASE WHEN regexp_matches({key}, '^[^{{]*\{{[^}}]*\}}') "
        rf"THEN regexp_extract({key}, '^[^{{]*\{{([^}}]*)\}}', 1) ELSE {key} END"
    )
    x = "xor(xor(c >> 8, b), xor(c >> 8, b) >> 4)"
    step = f"xor(xor((c << 8) & 65535, ({x} << 12) & 65535), xor({x} << 5, {x}))"
    codes = f"list_transform(string_split({tag}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"(list_reduce(list_prepend(0::BIGINT, {codes}), lambda c, b: {step}) % 16384)::INT"


def rate(matched: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN {matched}::DOUBLE / {total} * 100 ELSE 0.0::DOUBLE END AS consistency_rate"


def human(size: str) -> str:
    return (
        f"CASE WHEN {size} < 1024 THEN printf('%d B', {size}) "
        f"WHEN {size} < 1048576 THEN printf('%.2f KB', {size} / 1024.0::DOUBLE) "
        f"WHEN {size} < 1073741824 THEN printf('%.2f MB', {size} / 1048576.0::DOUBLE) "
        f"ELSE printf('%.2f GB', {size} / 1073741824.0::DOUBLE) END"
    )


def duration(s: str) -> str:
    return (
        f"CASE WHEN {s} IS NULL OR {s} < 0 THEN '-' WHEN {s} < 60 THEN {s} || 's' "
        f"WHEN {s} < 3600 THEN {s} // 60 || 'm ' || {s} % 60 || 's' "
        f"WHEN {s} < 86400 THEN {s} // 3600 || 'h ' || {s} % 3600 // 60 || 'm' "
        f"ELSE {s} // 86400 || 'd ' || {s} % 86400 // 3600 || 'h' END"
    )


KEYSPACE = "key, type, value, ttl_s, node"

# --- scans, sources, sinks

SCAN_KEYSPACE = f"""
  SELECT {KEYSPACE} FROM raw QUALIFY row_number() OVER (PARTITION BY key ORDER BY node, type, value, ttl_s) = 1"""
define("scan_keyspace", "raw", SCAN_KEYSPACE)
define("key_snapshot", "raw", "SELECT DISTINCT key FROM raw")
define("keyspace_size", "src", "SELECT node, count(*) AS keys FROM src GROUP BY ROLLUP (node)")


def line(name: str) -> str:
    """Text after ``name:`` on the first line that starts so."""
    lines = "list_transform(string_split(info, chr(10)), lambda l: trim(l, ' ' || chr(13) || chr(9)))"
    return f"list_filter({lines}, lambda l: starts_with(l, '{name}:'))[1][{len(name) + 2}:]"


def number(name: str) -> str:
    return f"coalesce(TRY_CAST({line(name)} AS BIGINT), 0)"


derive(
    "nodes",
    f"""
  SELECT cluster, node, keys, maxclients AS max_clients, coalesce({line("redis_version")}, 'unknown') AS version,
    {number("used_memory")} AS used_memory, {number("maxmemory")} AS max_memory,
    {number("instantaneous_ops_per_sec")} AS ops, {number("connected_clients")} AS clients
  FROM reports""",
)
define("scan_node_info", "reports nodes", "SELECT * FROM nodes")
define(
    "scan_log_text",
    "logs",
    """SELECT timestamp, level, request_id, task_id, source, message,
         fields FROM logs""",
)
define("change_feed", "chg", 'SELECT node_id, key, op, value, ttl_s, epoch_us(ts) AS ts_us, "offset" FROM chg')


MERGED_SKIP = f"""
  SELECT {KEYSPACE} FROM tgt
  UNION ALL SELECT key, type, value, greatest(ttl_s, 0), node FROM src WHERE key NOT IN (SELECT key FROM tgt)"""
MERGED_REPLACE = f"""
  SELECT key, type, value, greatest(ttl_s, 0) AS ttl_s, node FROM src
  UNION ALL SELECT {KEYSPACE} FROM tgt WHERE key NOT IN (SELECT key FROM src)"""
define(
    "write_snapshot",
    "src tgt",
    f"SELECT key, type, value, ttl_s, ({slot_of('key')} * 64 // 16384)::INT AS slot_bucket FROM ({MERGED_SKIP})",
)
define(
    "merge_versions",
    "src tgt known",
    f"""
  SELECT key, type, value, greatest(ttl_s, 0) AS ttl_s, node FROM known
  UNION ALL SELECT * FROM ({MERGED_SKIP}) WHERE key NOT IN (SELECT key FROM known)""",
)
define("append_metrics", "metric", "SELECT * FROM metric")

derive(
    "resolved",
    """
  SELECT task_id, key, coalesce(final.outcome, 'failed') AS outcome,
    coalesce(final.attempt, least(tries, 3))::INT AS attempts,
    CASE WHEN final IS NULL THEN '(after 3 retries)' END AS detail,
    (coalesce(final.attempt, least(tries, 3)) * (coalesce(final.attempt, least(tries, 3)) - 1) // 2 * 100)::BIGINT
      AS waited_ms
  FROM (SELECT task_id, key, max(attempt) AS tries,
          min({'attempt': attempt, 'outcome': outcome}) FILTER (outcome IN ('ok', 'skipped') AND attempt <= 3) AS final
        FROM att GROUP BY task_id, key)""",
)
derive(
    "errors",
    """
  SELECT task_id, split_part(key, ':', 2)::BIGINT AS seq, key, 'string' AS type, outcome AS reason,
    concat_ws(' ', 'restore of "key" refused,', outcome, detail) AS detail,
    strftime(make_timestamp((1700000000 + split_part(key, ':', 2)::BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp
  FROM resolved WHERE outcome <> 'ok'""",
)
define(
    "export_error_keys_csv",
    "att resolved errors",
    """SELECT '"' || key || '","' || type || '","' || reason || '","' || replace(detail, '"', '""') || '","' || timestamp
         || '"' AS value FROM errors
       UNION ALL SELECT '"Key","Type","Reason","Detail","Timestamp"' """,
)
derive("failing", "SELECT * FROM logs WHERE level = 'ERROR' AND contains(lower(message), 'err')")
LINE = """'[' || timestamp || '] [' || level || '] [req:' || request_id || '] [task:' || task_id
  || '] [' || source || '] ' || message || ' ' || fields"""
define(
    "export_logs_text",
    "logs failing",
    f"""
  SELECT unnest(['=== Log Export ===', 'Export Time: 2024-02-01 00:00:00', 'Total Entries: ' || count(*),
    'Filter: level=error, keyword=err, task=', repeat('=', 50), '']) AS value FROM failing
  UNION ALL SELECT unnest([{LINE}, 'Stack Trace:', stack]) FROM failing""",
)
define("export_logs_json", "logs", "SELECT * FROM logs WHERE starts_with(task_id, 'task-3')")
define(
    "run_report",
    "runs stats batches",
    """
  , whole AS (SELECT r.*, c.c_nationkey AS n, c.c_mktsegment AS config FROM runs r JOIN customer c ON r.id = 'task-' || c.c_custkey),
  more AS (SELECT 'task-' || o_custkey AS task_id, count(*) FILTER (o_totalprice > 300000) AS large_keys_count,
    count(*) FILTER (o_orderstatus = 'O') AS skipped_keys_count, min(epoch_us(o_orderdate) // 1000000) AS start_time,
    max(epoch_us(o_orderdate) // 1000000) AS end_time FROM orders GROUP BY o_custkey)
  SELECT id AS run_id, 1 AS section, to_json({'id': id, 'name': name, 'status': status, 'source': 'cluster-' || n,
    'target': 'cluster-' || (n + 1) % 25, 'config': config, 'created_at': created_at, 'updated_at': created_at + 30,
    'started_at': CASE WHEN status <> 'pending' THEN created_at + 10 END,
    'completed_at': CASE WHEN status IN ('completed', 'failed') THEN created_at + 50 END})::VARCHAR AS document FROM whole
  UNION ALL
  SELECT id, 2, to_json({'task_id': id, 'total_keys': coalesce(total_keys, 0), 'migrated_keys': coalesce(migrated_keys, 0),
    'total_bytes': coalesce(total_bytes, 0), 'migrated_bytes': coalesce(migrated_bytes, 0),
    'large_keys_count': coalesce(large_keys_count, 0), 'skipped_keys_count': coalesce(skipped_keys_count, 0),
    'error_count': coalesce(error_count, 0), 'start_time': start_time, 'end_time': end_time})::VARCHAR
  FROM runs LEFT JOIN stats ON id = stats.task_id LEFT JOIN more ON id = more.task_id
  UNION ALL
  SELECT task_id, 3, to_json({'id': id, 'task_id': task_id, 'batch_id': batch_id, 'total_keys': total_keys,
    'matched_keys': matched_keys, 'mismatched_keys': mismatched_keys, 'missing_keys': missing_keys, 'extra_keys': id % 3,
    'details': o_orderpriority, 'created_at': created_at})::VARCHAR
  FROM batches JOIN orders ON id = o_orderkey WHERE task_id IN (SELECT id FROM runs)""",
)
define(
    "union_scans",
    "src users",
    "SELECT key FROM src UNION SELECT 'order:' || l_orderkey FROM lineitem UNION SELECT key FROM users",
)

# --- filters

define(
    "filter_keys_prefix",
    "src",
    """SELECT * FROM src WHERE (starts_with(key, 'order:1') OR starts_with(key, 'order:2'))
         AND NOT starts_with(key, 'order:13')""",
)
define(
    "filter_keys_pattern",
    "src",
    "SELECT * FROM src WHERE regexp_matches(key, '5$') OR regexp_matches(key, '^order:1[0-3]')",
)
define("filter_keys_contains", "src", "SELECT * FROM src WHERE contains(key, '77') OR contains(key, '9:')")
define("filter_keys_list", "src", "SELECT * FROM src WHERE key IN ('order:1', 'order:2', 'order:77')")
define("filter_keys_table", "src listed", "SELECT * FROM src WHERE key IN (SELECT key FROM listed)")
define(
    "filter_keys_exclude",
    "src",
    """SELECT * FROM src WHERE NOT starts_with(key, 'order:9') AND NOT regexp_matches(key, '7.*7')
         AND NOT regexp_matches(key, '00$')""",
)
define("filter_keys_exclude_table", "src listed", "SELECT * FROM src WHERE key NOT IN (SELECT key FROM listed)")
derive(
    "verdicts",
    """
  SELECT *, CASE WHEN starts_with(key, 'order:13') THEN 'exclude_prefix' WHEN contains(key, '99') THEN 'exclude_pattern'
    WHEN starts_with(key, 'order:1') OR starts_with(key, 'order:7') THEN 'include_prefix' ELSE 'not_included' END AS rule
  FROM src""",
)
define(
    "filter_report",
    "src verdicts",
    "SELECT rule, rule = 'include_prefix' AS kept, count(*) AS keys FROM verdicts GROUP BY ALL",
)
define("select_in_slots_snapshot", "src", f"SELECT * FROM src WHERE {slot_of('key')} BETWEEN 4000 AND 8191")
define("select_in_slots", "src", f"SELECT * FROM src WHERE {slot_of('key')} BETWEEN 4096 AND 8191")

derive(
    "opts",
    """
  SELECT 'task-' || c AS id, c,
    CASE WHEN c % 500 IN (0, 7, 8) THEN 'all' WHEN c % 3 = 1 THEN 'keys' ELSE 'prefix' END AS mode,
    ['order:' || (1000 + c % 9000), 'order:7' || (c % 1000)] AS prefixes, ['order:' || c, 'order:' || (c * 7), 'ghost:1'] AS keys,
    CASE WHEN c % 500 IN (7, 8) THEN [] ELSE ['order:' || (10000 + c % 90000), 'order:' || (c * 7)] END AS excluded
  FROM (SELECT c_custkey AS c FROM customer)""",
)
define(
    "options_decode",
    "opts",
    """
  SELECT id, mode, CASE WHEN c % 4 = 0 AND c % 500 NOT IN (7, 8) THEN 'replace' ELSE 'skip_full_only' END AS conflict_policy,
    CASE WHEN c % 500 IN (7, 8) THEN 0 ELSE 2 END AS prefixes, CASE WHEN c % 500 IN (7, 8) THEN 0 ELSE 3 END AS keys FROM opts""",
)
define(
    "keys_of_runs",
    "src opts",
    """
  SELECT id AS run_id, count(*) AS keys, min(key) AS first_key, max(key) AS last_key FROM (
    SELECT id, key, excluded FROM src JOIN (SELECT id, excluded, unnest(keys) AS key FROM opts WHERE mode = 'keys') USING (key)
    UNION SELECT id, key, excluded FROM src, opts WHERE mode = 'all'
    UNION SELECT id, key, excluded FROM src, opts WHERE mode = 'prefix' AND (starts_with(key, prefixes[1]) OR starts_with(key, prefixes[2])))
  WHERE len(excluded) = 0 OR NOT (starts_with(key, excluded[1]) OR starts_with(key, excluded[2])) GROUP BY id""",
)

# --- slots

define("with_slot", "raw", f"SELECT key, {slot_of('key')} AS slot FROM (SELECT DISTINCT key FROM raw)")
derive(
    "hist",
    f"""SELECT slot, count(*) AS keys, sum(strlen(value))::BIGINT AS bytes
        FROM (SELECT value, {slot_of("key")} AS slot FROM raw) GROUP BY slot""",
)
define("slot_histogram", "raw hist", "SELECT * FROM hist")
define(
    "slot_skew",
    "src",
    f"""
  SELECT count(*) AS used_slots, max(keys) AS max_keys, sum(keys)::BIGINT AS total_keys,
    (max(keys) * count(*))::DOUBLE / sum(keys)::DOUBLE AS skew
  FROM (SELECT {slot_of('key')} AS slot, count(*) AS keys FROM src GROUP BY slot)""",
)
RANGES = """
  SELECT task_id, 'worker-' || i AS worker_id, (i * (16384 // workers))::INT AS slot_start,
    (CASE WHEN i = workers - 1 THEN 16383 ELSE (i + 1) * (16384 // workers) - 1 END)::INT AS slot_end
  FROM (SELECT *, unnest(range(0, workers)) AS i FROM ({plan}))"""
define(
    "slot_ranges",
    "",
    RANGES.format(plan="SELECT 'task-' || c_custkey AS task_id, 1 + c_custkey % 16 AS workers FROM customer"),
)
derive(
    "ranges",
    RANGES.format(plan="SELECT 'nation-' || s_nationkey AS task_id, count(*) AS workers FROM supplier GROUP BY s_nationkey"),
)
define(
    "range_workload",
    "raw hist ranges",
    """
  SELECT task_id, worker_id, slot_start, slot_end, coalesce(sum(keys), 0)::BIGINT AS keys,
    coalesce(sum(bytes), 0)::BIGINT AS bytes
  FROM ranges LEFT JOIN hist ON slot BETWEEN slot_start AND slot_end GROUP BY ALL""",
)

# --- merge

PLAN = """
  SELECT s.key, s.type, CASE WHEN t.key IS NULL THEN 'migrated' ELSE '{outcome}' END AS outcome,
    CASE WHEN t.key IS NOT NULL THEN '{detail}' END AS detail,
    CASE WHEN t.key IS NULL THEN strlen(s.value) ELSE 0 END::BIGINT AS bytes_moved
  FROM src s LEFT JOIN tgt t USING (key)"""
SKIPPED = PLAN.format(outcome="skipped", detail="Key already exists in target")
FAILED = PLAN.format(outcome="failed", detail="key conflict")
REPLACED = """SELECT key, type, 'migrated' AS outcome, NULL::VARCHAR AS detail, strlen(value)::BIGINT AS bytes_moved FROM src"""
define("plan_merge_skip", "src tgt", SKIPPED)
define("plan_merge_full_phase", "src tgt", SKIPPED)
define("plan_merge_error", "src tgt", FAILED)
define("plan_merge_replace", "src", REPLACED)
define("plan_merge_incremental_phase", "src", REPLACED)
define("batch_exists", "src tgt", 'SELECT key, key IN (SELECT key FROM tgt) AS "exists" FROM src')
define("merge_result_skip", "src tgt", MERGED_SKIP)
define("merge_result_replace", "src tgt", MERGED_REPLACE)
define("conflict_log", "src tgt", "SELECT key, type FROM src SEMI JOIN tgt USING (key)")
define("new_keys", "src known", "SELECT * FROM src ANTI JOIN known USING (key)")
define(
    "snapshot_diff",
    "src tgt",
    """
  SELECT key, 'new' AS status FROM (SELECT key FROM src EXCEPT SELECT key FROM tgt)
  UNION ALL SELECT key, 'common' FROM (SELECT key FROM src INTERSECT SELECT key FROM tgt)
  UNION ALL SELECT key, 'gone' FROM (SELECT key FROM tgt EXCEPT SELECT key FROM src)""",
)
derive(
    "fresh",
    """SELECT *, starts_with(key, 'order:1') OR starts_with(key, 'order:3') AS kept FROM src ANTI JOIN known USING (key)""",
)
define(
    "incremental_batch",
    "src known fresh",
    """
  SELECT key, type, CASE WHEN kept THEN 'migrated' ELSE 'filtered' END AS outcome,
    CASE WHEN NOT kept THEN 'not_included' END AS detail, CASE WHEN kept THEN strlen(value) ELSE 0 END::BIGINT AS bytes_moved
  FROM fresh""",
)
define(
    "incremental_batch_target",
    "src tgt known fresh",
    f"""
  SELECT key, type, value, greatest(ttl_s, 0) AS ttl_s, node FROM fresh WHERE kept
  UNION ALL SELECT {KEYSPACE} FROM tgt WHERE key NOT IN (SELECT key FROM fresh WHERE kept)""",
)
APPLY_CHANGES = """
  , writes AS (SELECT * FROM chg WHERE op <> 'expire'
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, "offset" DESC, node_id DESC) = 1),
  expires AS (SELECT * FROM chg WHERE op = 'expire'
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, "offset" DESC, node_id DESC) = 1)
  SELECT key, coalesce(u.type, 'string') AS type, coalesce(w.value, u.value) AS value,
    greatest(coalesce(CASE WHEN e.key IS NOT NULL AND (w.key IS NULL OR (e.ts, e."offset") > (w.ts, w."offset"))
      THEN e.ttl_s WHEN w.key IS NOT NULL THEN w.ttl_s ELSE u.ttl_s END, 0), 0) AS ttl_s, coalesce(u.node, 0) AS node
  FROM users u FULL JOIN writes w USING (key) LEFT JOIN expires e USING (key)
  WHERE coalesce(w.op, '') <> 'del' AND coalesce(w.value, u.value) IS NOT NULL"""
define("apply_changes", "users chg", APPLY_CHANGES)
define("apply_few_changes", "users chg", APPLY_CHANGES)
APPLY_RENAMES = """
  , ren AS (SELECT * REPLACE (
        CASE WHEN "offset" % 7 = 0 THEN 'rename' ELSE op END AS op,
        CASE WHEN "offset" % 7 <> 0 THEN value END AS value, CASE WHEN "offset" % 7 <> 0 THEN ttl_s END AS ttl_s),
      'user:' || (split_part(key, ':', 2)::BIGINT + "offset" % 4) AS new_key FROM chg),
  w AS (SELECT key, (ts, "offset") AS moment, op, value, ttl_s, NULL::VARCHAR AS origin FROM ren WHERE op IN ('set', 'del')
    UNION ALL SELECT key, (ts, "offset"), 'del', NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR FROM ren WHERE op = 'rename' AND key <> new_key
    UNION ALL SELECT new_key, (ts, "offset"), 'move', NULL::VARCHAR, NULL::BIGINT, key FROM ren WHERE op = 'rename' AND key <> new_key),
  x AS (SELECT key, (ts, "offset") AS moment, ttl_s FROM ren WHERE op = 'expire'),
  -- questions: what each key holds in the end (moment null), and what old and new key of each rename held before it
  asked AS (SELECT origin AS key, moment FROM w WHERE op = 'move' UNION SELECT key, moment FROM w WHERE op = 'move'
    UNION SELECT key, NULL FROM (SELECT key FROM w UNION SELECT key FROM users)),
  last_w AS (SELECT a.key, a.moment, max(w.moment) AS w_at FROM asked a LEFT JOIN w ON w.key = a.key AND (a.moment IS NULL OR w.moment < a.moment)
    GROUP BY ALL),
  answer AS (SELECT l.key, l.moment, l.w_at, max(x.moment) AS x_at FROM last_w l LEFT JOIN x ON x.key = l.key
      AND (l.moment IS NULL OR x.moment < l.moment) AND (l.w_at IS NULL OR x.moment > l.w_at) GROUP BY ALL),
  step AS (SELECT a.key, a.moment, w.moment AS w_at, coalesce(w.op, 'base') AS op, w.value, w.ttl_s, w.origin,
      x.moment IS NOT NULL AS expired, x.ttl_s AS x_ttl,
      coalesce(w.op, 'base') = 'set' OR (w.op IS NULL AND u.key IS NOT NULL) AS there
    FROM answer a LEFT JOIN w ON w.key = a.key AND w.moment = a.w_at LEFT JOIN x ON x.key = a.key AND x.moment = a.x_at
      LEFT JOIN users u ON u.key = a.key),
  -- a rename leads to its old key; if nothing was there, back to what the new key held before the rename
  chase AS (SELECT key AS k, key, op, value, ttl_s, origin, w_at, expired, x_ttl, there,
      [{'key': key, 'moment': w_at, 'expired': expired, 'x_ttl': x_ttl}][2:] AS back
    FROM step WHERE moment IS NULL
    UNION ALL
    SELECT c.k, s.key, s.op, s.value, s.ttl_s, s.origin, s.w_at, c.over.expired OR s.expired,
      CASE WHEN c.over.expired THEN c.over.x_ttl ELSE s.x_ttl END, s.there, c.back
    FROM (SELECT k, CASE WHEN op = 'move' THEN {'key': origin, 'moment': w_at, 'expired': expired, 'x_ttl': x_ttl} ELSE back[-1] END AS over,
        CASE WHEN op = 'move' THEN list_append(back, {'key': key, 'moment': w_at, 'expired': expired, 'x_ttl': x_ttl}) ELSE back[:-2] END AS back
      FROM chase WHERE op = 'move' OR (NOT there AND len(back) > 0)) c
    JOIN step s ON s.key = c.over.key AND s.moment = c.over.moment),
  state AS (SELECT c.k AS key, coalesce(u.type, 'string') AS type, coalesce(c.value, u.value) AS value,
      greatest(coalesce(CASE WHEN c.expired THEN c.x_ttl WHEN c.op = 'set' THEN c.ttl_s ELSE u.ttl_s END, 0), 0) AS ttl_s,
      coalesce(u.node, 0) AS node
    FROM chase c LEFT JOIN users u ON u.key = c.key WHERE c.there AND c.op <> 'move')
  SELECT * FROM state WHERE value IS NOT NULL"""
define("apply_renames", "users chg", APPLY_RENAMES)

define(
    "migrate",
    "raw tgt",
    f"""
  SELECT key, type, value, 0::BIGINT AS ttl_s, node FROM ({SCAN_KEYSPACE})
  WHERE (starts_with(key, 'li:{{1') OR starts_with(key, 'li:{{2')) AND NOT starts_with(key, 'li:{{13')
  UNION ALL SELECT {KEYSPACE} FROM tgt""",
)
define(
    "migrate_summary",
    "src tgt",
    f"""
  SELECT *, (keys_migrated + keys_skipped + keys_filtered)::DOUBLE / keys_total * 100 AS percentage FROM (
    SELECT count(*) AS keys_total, count(*) FILTER (kept AND outcome = 'migrated') AS keys_migrated,
      count(*) FILTER (kept AND outcome = 'skipped') AS keys_skipped, count(*) FILTER (NOT kept) AS keys_filtered,
      0::BIGINT AS keys_failed, sum(CASE WHEN kept THEN bytes_moved ELSE 0 END)::BIGINT AS bytes_migrated
    FROM (SELECT *, regexp_matches(key, '[0-4]$') AS kept FROM ({SKIPPED})))""",
)

# --- verification

derive(
    "checked",
    """
  SELECT coalesce(s.key, t.key) AS key, coalesce(s.type, t.type) AS type,
    CASE WHEN s.key IS NULL THEN 'extra' WHEN t.key IS NULL THEN 'missing'
      WHEN s.value = t.value AND s.type = t.type THEN 'matched' ELSE 'mismatched' END AS status
  FROM src s FULL JOIN tgt t ON s.key = t.key""",
)
COUNTS = """count(*) FILTER (status <> 'extra') AS total_keys, count(*) FILTER (status = 'matched') AS matched_keys,
  count(*) FILTER (status = 'mismatched') AS mismatched_keys, count(*) FILTER (status = 'missing') AS missing_keys"""
RATE = rate("count(*) FILTER (status = 'matched')", "count(*) FILTER (status <> 'extra')")
EXTRA = "count(*) FILTER (status = 'extra') AS extra_keys"
define("sample_keys", "src", "SELECT key FROM src ORDER BY md5(key), key LIMIT 5000")
define("verify_rows", "src tgt checked", "SELECT * FROM checked WHERE status <> 'extra'")
define(
    "verify_summary",
    "src tgt checked",
    f"""SELECT {COUNTS}, {RATE} FROM checked WHERE key IN (SELECT key FROM src ORDER BY md5(key), key LIMIT 10000)""",
)
define("verify_full", "src tgt checked", "SELECT * FROM checked")
define("verify_tree", "src tgt checked", "SELECT * FROM checked")
define("verify_tree_faults", "src tgt checked", "SELECT * FROM checked WHERE status <> 'matched'")
define("verify_full_summary", "src tgt checked", f"SELECT {COUNTS}, {EXTRA}, {RATE} FROM checked")


derive(
    "canon",
    """
  SELECT 'order:' || o_orderkey AS key, 'hash' AS type, to_json([{'key': 'customer', 'value': o_custkey::VARCHAR},
    {'key': 'priority', 'value': o_orderpriority}, {'key': 'status', 'value': o_orderstatus}])::VARCHAR AS value FROM orders
  UNION ALL
  SELECT 'talk:' || conv_id || ':' || turn, 'list', to_json(string_split(text, ' '))::VARCHAR FROM conversations
  UNION ALL
  SELECT 'doc:' || doc_id, 'set', to_json(list_sort(list_distinct(string_split(text, ' '))))::VARCHAR FROM documents
  UNION ALL
  SELECT 'part:' || p_partkey, 'zset', to_json(list_sort(list_transform(string_split(p_name, ' '),
    lambda w, i: {'score': p_size - i + 1, 'member': w})))::VARCHAR FROM part""",
)
define(
    "canonical_values", "canon", "SELECT key, type, strlen(value)::BIGINT AS bytes, md5(value) AS digest FROM canon"
)
define(
    "verify_by_type",
    "canon",
    f"""
  SELECT "group", {COUNTS}, {RATE} FROM (
    SELECT type AS "group", CASE WHEN substr(md5(value), 2, 1) = 'b' THEN 'missing'
      WHEN substr(md5(value), 1, 1) = 'a' THEN 'mismatched' ELSE 'matched' END AS status FROM canon)
  GROUP BY "group" """,
)
define(
    "verify_by_slot_bucket",
    "src tgt checked",
    f"""
  SELECT ({slot_of("key")} * 32 // 16384)::INT AS "group", {COUNTS}, {RATE} FROM checked WHERE status <> 'extra'
  GROUP BY 1""",
)
define(
    "differing_ranges",
    "src tgt checked",
    f"""
  SELECT (slot * 256 // 16384)::INT AS range, sum(source_keys)::BIGINT AS source_keys, sum(target_keys)::BIGINT AS target_keys,
    count(*) AS slots, count(*) FILTER (faults > 0) AS differing_slots
  FROM (SELECT {slot_of("key")} AS slot, count(*) FILTER (status <> 'extra') AS source_keys,
      count(*) FILTER (status <> 'missing') AS target_keys, count(*) FILTER (status <> 'matched') AS faults
    FROM checked GROUP BY 1)
  GROUP BY 1""",
)
define(
    "verify_two_level",
    "src tgt checked",
    f"""
  , sampled AS (SELECT key FROM src ORDER BY md5(key), key LIMIT 1500),
  grouped AS (SELECT *, substr(key, 1, 9) AS "group" FROM checked),
  level1 AS (SELECT "group", {COUNTS}, {RATE} FROM grouped SEMI JOIN sampled USING (key) GROUP BY "group")
  SELECT *, 0::BIGINT AS extra_keys, 1 AS level FROM level1
  UNION ALL BY NAME
  SELECT "group", {COUNTS}, {EXTRA}, {RATE}, 2 AS level FROM grouped
  WHERE "group" IN (SELECT "group" FROM level1 WHERE matched_keys < total_keys) GROUP BY "group" """,
)
define("verify_history", "batches", f"SELECT *, {rate('matched_keys', 'total_keys')} FROM batches")

# --- aggregates and progress

SUMMARY = """
  SELECT count(*) AS keys_total, count(*) FILTER (outcome = 'migrated') AS keys_migrated,
    count(*) FILTER (outcome = 'skipped') AS keys_skipped, count(*) FILTER (outcome = 'filtered') AS keys_filtered,
    count(*) FILTER (outcome = 'failed') AS keys_failed, coalesce(sum(bytes_moved), 0)::BIGINT AS bytes_migrated
  FROM ({rows})"""
define("migration_summary", "src tgt", SUMMARY.format(rows=SKIPPED))
define(
    "migration_summary_filtered",
    "src tgt verdicts",
    SUMMARY.format(
        rows=f"""
    SELECT CASE WHEN rule = 'include_prefix' THEN outcome ELSE 'filtered' END AS outcome,
      CASE WHEN rule = 'include_prefix' THEN bytes_moved ELSE 0 END AS bytes_moved
    FROM ({FAILED}) JOIN (SELECT key, rule FROM verdicts) USING (key)"""
    ),
)
define(
    "progress_share",
    "counters",
    """
  SELECT task_id, least((keys_migrated + keys_skipped + keys_filtered)::DOUBLE / keys_total * 100, 100.0::DOUBLE)
    AS handled_percentage, keys_migrated::DOUBLE / keys_total * 100 AS percentage FROM counters""",
)
define(
    "throughput_eta",
    "counters",
    f"""
  SELECT task_id, speed, eta_s, {duration("eta_s")} AS eta_text, {duration("elapsed")} AS elapsed_text FROM (
    SELECT *, CASE WHEN speed > 0 AND keys_total > keys_migrated THEN (keys_total - keys_migrated) // speed END AS eta_s
    FROM (SELECT *, 1700003600 - started_at AS elapsed,
            CASE WHEN 1700003600 > started_at THEN keys_migrated // (1700003600 - started_at) ELSE 0 END AS speed
          FROM counters))""",
)
define(
    "worker_totals",
    "prog",
    """
  SELECT task_id, worker_id, sum(keys_processed)::BIGINT AS keys, sum(bytes_sent)::BIGINT AS bytes,
    sum(error_count)::BIGINT AS errors, epoch_us(max(ts)) AS last_active
  FROM prog GROUP BY GROUPING SETS ((task_id, worker_id), (task_id))""",
)
define("metric_series", "metric", "SELECT * FROM metric WHERE timestamp BETWEEN 1704500000 AND 1706000000")
define(
    "log_level_stats",
    "logs",
    """
  SELECT level, count(logs.id) AS entries
  FROM (SELECT unnest(['DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL']) AS level) LEFT JOIN logs USING (level) GROUP BY level
  UNION ALL SELECT 'TOTAL', count(*) FROM logs""",
)
STATUSES = ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "running", "paused", "completed", "failed")
)
define("status_counts", "runs", f"SELECT count(*) AS total, {STATUSES} FROM runs")
define(
    "error_key_stats",
    "att resolved errors docs",
    """
  SELECT task_id, count(*) AS total, count(*) FILTER (reason = 'failed') AS failed,
    count(*) FILTER (reason = 'skipped') AS skipped, coalesce(any_value(large_keys), 0) AS large_keys
  FROM errors LEFT JOIN (SELECT 'task-' || doc_id % 7 AS task_id, count(*) AS large_keys FROM docs
    WHERE strlen(value) >= 16384 GROUP BY 1) USING (task_id) GROUP BY task_id""",
)
derive(
    "clusters",
    f"""
  SELECT *, {human("used_memory")} AS memory_text FROM (
    SELECT cluster, sum(keys)::BIGINT AS keys, sum(used_memory)::BIGINT AS used_memory, max(max_memory) AS max_memory,
      sum(ops)::BIGINT AS ops, sum(clients)::BIGINT AS clients, max(max_clients)::INT AS max_clients, count(*) AS nodes,
      arg_min(version, node) AS version, sum(used_memory)::BIGINT // sum(keys)::BIGINT AS avg_key_bytes
    FROM nodes GROUP BY cluster)""",
)
define("cluster_summary", "reports nodes clusters", "SELECT * FROM clusters")
define(
    "recommend_config",
    "reports nodes clusters",
    f"""
  , p AS (SELECT n_nationkey::VARCHAR AS source, ((n_nationkey * 3 + 1) % 25)::VARCHAR AS target FROM nation),
  a AS (SELECT source, target, s.ops AS s_ops, t.ops AS t_ops, s.keys AS s_keys, s.avg_key_bytes AS size,
      greatest(s.max_clients - s.clients, 100) AS s_free, greatest(t.max_clients - t.clients, 100) AS t_free
    FROM p JOIN clusters s ON s.cluster = source JOIN clusters t ON t.cluster = target),
  b AS (SELECT *, greatest(least(32, least(s_free, t_free) // 3,
      CASE WHEN s_ops < 1000 THEN 100 WHEN s_ops < 10000 THEN 50 ELSE 20 END, 100), 4)::BIGINT AS workers,
      CASE WHEN s_ops < 100 THEN 0 ELSE greatest(2 * s_ops, 50000) * 30 // 100 END AS source_qps,
      CASE WHEN t_ops < 100 THEN 0 ELSE greatest(2 * t_ops, 50000) * 50 // 100 END AS target_qps FROM a),
  c AS (SELECT *, workers * CASE WHEN size < 1024 THEN 500 WHEN size < 10240 THEN 200 WHEN size < 102400 THEN 50 ELSE 10 END
      AS raw_speed FROM b),
  d AS (SELECT *, CASE WHEN source_qps > 0 AND source_qps < raw_speed * 4 THEN source_qps // 4 ELSE raw_speed END AS speed
    FROM c),
  e AS (SELECT *, CASE WHEN speed > 0 AND s_keys > 0 THEN s_keys // speed END AS seconds FROM d)
  SELECT source, target, workers, 1000 AS scan_batch, source_qps, target_qps,
    greatest(least(workers * 3, s_free // 2), 10) AS source_connections,
    greatest(least(workers * 3, t_free // 2), 10) AS target_connections,
    CASE WHEN size > 1048576 THEN 5242880 ELSE 10485760 END::BIGINT AS large_key_bytes, speed, seconds,
    {duration("seconds")} AS time_text,
    concat_ws('; ', CASE WHEN s_ops < 1000 THEN 'source load is low' WHEN s_ops < 10000 THEN 'source load is medium'
        ELSE 'source load is high' END,
      CASE WHEN s_ops < 100 THEN 'source is idle, no QPS limit'
        ELSE 'source QPS limited to 30% of capacity (' || source_qps || ')' END,
      CASE WHEN t_ops < 100 THEN 'target is idle, no QPS limit' END,
      CASE WHEN size > 1048576 THEN 'average key is large, threshold lowered' END) AS reasons
  FROM e""",
)
define(
    "prefix_profile",
    "src tgt docs",
    f"""
  SELECT *, bytes::DOUBLE / keys AS avg_bytes, {human("bytes")} AS bytes_text FROM (
    SELECT split_part(key, ':', 1) AS prefix, count(*) AS keys, sum(strlen(value))::BIGINT AS bytes
    FROM (SELECT key, value FROM src UNION ALL SELECT key, value FROM tgt UNION ALL SELECT key, value FROM docs)
    GROUP BY 1)""",
)

# --- windows, sorts, limits, retention

derive(
    "judged",
    """
  SELECT task_id, iteration, change_count, total_keys, ts,
    CASE WHEN change_count < 1000 THEN 'change_count_below_threshold'
      WHEN total_keys > 0 AND change_count::DOUBLE / total_keys < 0.001 THEN 'change_rate_below_threshold'
      WHEN len(recent) >= 3 AND list_sum(list_transform(list_filter(recent, lambda r: r.ts > seen_at - INTERVAL 10 MINUTE),
        lambda r: r.n)) < 5000 THEN 'window_changes_stable'
      WHEN len(recent) >= 10 THEN 'max_iterations_reached' END AS reason
  FROM (SELECT *, ts AS seen_at, list({'ts': ts, 'n': change_count}) OVER (PARTITION BY task_id ORDER BY iteration
          ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM conv)""",
)
define(
    "convergence_by_iteration",
    "conv judged",
    """SELECT task_id, iteration, change_count, total_keys, epoch_us(ts) // 1000000 AS ts, reason IS NOT NULL AS converged,
         reason FROM judged""",
)
STOP = """
  SELECT task_id, min(iteration) FILTER (reason IS NOT NULL) AS iteration,
    arg_min(reason, iteration) FILTER (reason IS NOT NULL) AS reason FROM judged GROUP BY task_id"""
define("convergence_stop", "conv judged", STOP)
derive(
    "latest",
    """
  SELECT * FROM ckpt QUALIFY row_number() OVER (PARTITION BY task_id, worker_id, slot_id ORDER BY updated_at DESC,
    seq DESC, cursor DESC, keys_migrated DESC, bytes_migrated DESC, last_key DESC) = 1""",
)
define("latest_checkpoint", "ckpt latest", "SELECT * FROM latest")
define(
    "resume_slots",
    "ckpt latest",
    f"""
  SELECT task_id, worker_id, slot::INT AS slot FROM (
    SELECT *, unnest(range(slot_start, slot_end + 1)) AS slot FROM ({
        RANGES.format(plan="SELECT task_id, count(DISTINCT worker_id) AS workers FROM ckpt GROUP BY task_id")}))
  WHERE (task_id, slot) NOT IN (SELECT (task_id, slot_id) FROM latest WHERE cursor = '0' AND keys_migrated > 0)""",
)
CAPPED = "SELECT * FROM errors QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq, key) <= {cap}"
define("cap_error_keys", "att resolved errors", CAPPED.format(cap=10_000))
define("cap_error_keys_tight", "att resolved errors", CAPPED.format(cap=1200))
define("shown_error_keys", "att resolved errors", CAPPED.format(cap=100))
KEPT_RUNS = """
  SELECT * FROM runs WHERE status = 'running' OR id IN (SELECT id FROM runs ORDER BY created_at DESC, id DESC LIMIT 3)"""
define("retain_runs", "runs", KEPT_RUNS)
define("retain_logs", "logs", "SELECT * FROM logs ORDER BY id DESC LIMIT 5000")
derive("dropped", f"SELECT id FROM runs WHERE id NOT IN (SELECT id FROM ({KEPT_RUNS}))")
CHILDREN = {
    "slot_assignments": """SELECT 'task-' || c AS task_id, concat_ws('|', 'worker-' || i, i * (16384 // w),
      CASE WHEN i = w - 1 THEN 16383 ELSE (i + 1) * (16384 // w) - 1 END) AS row
      FROM (SELECT c, w, unnest(range(w)) AS i FROM (SELECT c_custkey AS c, 1 + c_custkey % 4 AS w FROM customer))""",
    "checkpoints": """SELECT task_id, concat_ws('|', worker_id, slot_id, cursor, keys_migrated, bytes_migrated, last_key, updated_at, seq) AS row
      FROM ckpt""",
    "large_key_progress": """SELECT 'task-' || doc_id % 7 AS task_id, concat_ws('|', key, strlen(value)) AS row
      FROM docs WHERE strlen(value) >= 16384""",
    "verification_results": """SELECT task_id, concat_ws('|', id, batch_id, total_keys, matched_keys, mismatched_keys, missing_keys, id % 3,
      o_orderpriority, created_at) AS row FROM batches JOIN orders ON id = o_orderkey""",
    "migration_stats": """SELECT task_id, concat_ws('|', total_keys, migrated_keys, total_bytes, migrated_bytes, large, skipped, error_count,
      first, last) AS row FROM stats JOIN (SELECT 'task-' || o_custkey AS task_id, count(*) FILTER (o_totalprice > 300000) AS large,
        count(*) FILTER (o_orderstatus = 'O') AS skipped, min(epoch_us(o_orderdate) // 1000000) AS first,
        max(epoch_us(o_orderdate) // 1000000) AS last FROM orders GROUP BY o_custkey) USING (task_id)""",
    "metrics": "SELECT task_id, concat_ws('|', metric_name, metric_value::DECIMAL(18,4), timestamp) AS row FROM metric",
    "logs": "SELECT task_id, concat_ws('|', id, level, message, request_id) AS row FROM logs",
}
define(
    "cascade_delete",
    "runs dropped batches stats ckpt metric logs docs",
    " UNION ALL ".join(
        f"""SELECT '{child}' AS child, task_id, row FROM ({rows}) WHERE task_id NOT IN (SELECT id FROM dropped)"""
        for child, rows in CHILDREN.items()
    ),
)
define(
    "list_runs",
    "runs",
    """SELECT *, count(*) OVER () AS total FROM runs WHERE status = 'completed' ORDER BY created_at DESC, id DESC
       LIMIT 30 OFFSET 30""",
)
define("search_runs", "runs", "SELECT * FROM runs WHERE contains(lower(name), lower('#00000012'))")
define("running_runs", "runs", "SELECT * FROM runs WHERE status = 'running' ORDER BY created_at DESC, id DESC LIMIT 3")
define(
    "search_logs",
    "logs",
    """
  SELECT *, count(*) OVER () AS total FROM logs WHERE level = 'WARN' AND task_id = 'task-2'
    AND contains(lower(message), 'purch') AND timestamp >= '2024-01-05' AND timestamp <= '2024-01-25'
  ORDER BY id DESC LIMIT 40 OFFSET 10""",
)
define(
    "search_logs_rest",
    "logs",
    """SELECT *, count(*) OVER () AS total FROM logs WHERE starts_with(task_id, 'task-') ORDER BY id DESC OFFSET 2500""",
)
define("resolve_attempts", "att resolved", "SELECT * FROM resolved")
define(
    "resolve_attempts_incremental",
    "att",
    """
  , firsts AS (SELECT DISTINCT ON (task_id, key) task_id, key, attempt, outcome FROM att
      WHERE outcome <> 'failed' AND attempt <= 2 ORDER BY task_id, key, attempt, outcome),
  tried AS (SELECT task_id, key, least(max(attempt), 2) AS n FROM att GROUP BY task_id, key)
  SELECT task_id, key, coalesce(outcome, 'failed') AS outcome, coalesce(attempt, n)::INT AS attempts,
    CASE WHEN outcome IS NULL THEN '(after 2 retries)' END AS detail,
    (coalesce(attempt, n) * (coalesce(attempt, n) - 1) // 2 * 1000)::BIGINT AS waited_ms
  FROM tried LEFT JOIN firsts USING (task_id, key)""",
)

# --- large values

define(
    "large_keys", "docs", "SELECT key, type, strlen(value)::BIGINT AS bytes FROM docs WHERE strlen(value) >= 16384"
)
define(
    "large_keys_top",
    "docs",
    "SELECT key, type, strlen(value)::BIGINT AS bytes FROM docs ORDER BY bytes DESC, key LIMIT 50",
)
derive(
    "parts",
    """
  SELECT key, total_bytes, parts, part_no, strlen(piece)::BIGINT // 2 AS part_bytes, md5(unhex(piece)) AS checksum FROM (
    SELECT *, substr(digits, part_no * 2000 + 1, 2000) AS piece FROM (
      SELECT *, unnest(range(0, parts))::INT AS part_no FROM (
        SELECT key, strlen(value)::BIGINT AS total_bytes, ((greatest(strlen(value), 1) - 1) // 1000 + 1)::INT AS parts,
          hex(encode(value)) AS digits FROM docs)))""",
)
define("split_large_values", "docs parts", "SELECT * FROM parts")
define(
    "large_key_progress",
    "docs parts",
    """
  SELECT key, total_bytes, parts, parts_done, transferred_bytes,
    CASE WHEN parts_done = parts THEN 'done' WHEN parts_done = 0 THEN 'pending' ELSE 'partial' END AS status
  FROM (SELECT key, total_bytes, parts, count(*) FILTER (good) AS parts_done,
          coalesce(sum(part_bytes) FILTER (good), 0)::BIGINT AS transferred_bytes
        FROM (SELECT *, substr(md5(key), 1, 1) > '3' OR part_no = 0 AS good FROM parts) GROUP BY ALL)""",
)

# --- streaming, as the batch result it must reach

define("stream_new_keys", "src known", "SELECT * FROM src ANTI JOIN known USING (key)")
define("stream_apply_changes", "users chg", APPLY_CHANGES)
define("stream_apply_renames", "users chg", APPLY_RENAMES)
define(
    "stream_progress",
    "prog",
    """
  SELECT task_id, worker_id, sum(keys_processed)::BIGINT AS keys, sum(bytes_sent)::BIGINT AS bytes,
    sum(error_count)::BIGINT AS errors FROM prog GROUP BY task_id, worker_id""",
)
define(
    "stream_throughput",
    "prog",
    """
  SELECT start_us, start_us + 10000000 AS end_us, task_id, sum(keys_processed)::BIGINT AS keys,
    sum(bytes_sent)::BIGINT AS bytes
  FROM (SELECT *, epoch_us(ts) // 10000000 * 10000000 AS start_us FROM prog)
  GROUP BY start_us, task_id""",
)
define(
    "liveness_sessions",
    "prog",
    """
    SELECT min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 30000000 AS end_us, worker_id, count(*) AS beats
    FROM (SELECT *, sum(opens) OVER (PARTITION BY worker_id ORDER BY ts) AS session
          FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) > INTERVAL 30 SECOND)::INT AS opens
                FROM prog))
    GROUP BY worker_id, session""",
)
define(
    "stream_silences",
    "prog",
    """
    SELECT worker_id, max(epoch_us(ts)) AS last_beat_us, max(epoch_us(ts)) + 30000000 AS silent_us, count(*) AS beats
    FROM (SELECT *, sum(opens) OVER (PARTITION BY worker_id ORDER BY ts) AS session
          FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) > INTERVAL 30 SECOND)::INT AS opens
                FROM prog))
    GROUP BY worker_id, session
    HAVING max(epoch_us(ts)) + 30000000 <= (SELECT max(epoch_us(ts)) - 10000000 FROM prog)""",
)
define("stream_convergence", "conv judged", STOP)
