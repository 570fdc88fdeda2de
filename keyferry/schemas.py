"""Fixed schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, TIME = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
STRINGS = T.ArrayType(STRING)


def struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


KEYSPACE = struct(key=STRING, type=STRING, value=STRING, ttl_s=LONG, node=INT)
TYPED = struct(
    key=STRING,
    type=STRING,
    str=STRING,
    hash=T.MapType(STRING, STRING),
    list=STRINGS,
    set=STRINGS,
    zset=T.ArrayType(struct(member=STRING, score=LONG)),
)
CHANGE = struct(
    node_id=STRING, key=STRING, op=STRING, value=STRING, ttl_s=LONG, new_key=STRING, ts=TIME, offset=LONG
)
RUN = struct(
    id=STRING,
    name=STRING,
    status=STRING,
    source=STRING,
    target=STRING,
    config=STRING,
    created_at=LONG,
    updated_at=LONG,
    started_at=LONG,
    completed_at=LONG,
)
SLOT_RANGE = struct(task_id=STRING, worker_id=STRING, slot_start=INT, slot_end=INT)
CHECKPOINT = struct(
    task_id=STRING,
    worker_id=STRING,
    slot_id=INT,
    cursor=STRING,
    keys_migrated=LONG,
    bytes_migrated=LONG,
    last_key=STRING,
    updated_at=LONG,
    seq=LONG,
)
VERIFY = struct(
    id=LONG,
    task_id=STRING,
    batch_id=STRING,
    total_keys=INT,
    matched_keys=INT,
    mismatched_keys=INT,
    missing_keys=INT,
    extra_keys=INT,
    details=STRING,
    created_at=LONG,
)
STATS = struct(
    task_id=STRING,
    total_keys=LONG,
    migrated_keys=LONG,
    total_bytes=LONG,
    migrated_bytes=LONG,
    large_keys_count=LONG,
    skipped_keys_count=LONG,
    error_count=LONG,
    start_time=LONG,
    end_time=LONG,
)
METRIC = struct(task_id=STRING, metric_name=STRING, metric_value=DOUBLE, timestamp=LONG)
ERROR_KEY = struct(
    task_id=STRING, seq=LONG, key=STRING, type=STRING, reason=STRING, detail=STRING, timestamp=STRING
)
LOG = struct(
    id=LONG,
    timestamp=STRING,
    level=STRING,
    message=STRING,
    source=STRING,
    request_id=STRING,
    task_id=STRING,
    fields=STRING,
    stack=STRING,
)
PROGRESS = struct(
    task_id=STRING, worker_id=STRING, keys_processed=LONG, bytes_sent=LONG, error_count=LONG, ts=TIME
)
PROGRESS_TOTALS = struct(task_id=STRING, worker_id=STRING, keys=LONG, bytes=LONG, errors=LONG)
THROUGHPUT = struct(start_us=LONG, end_us=LONG, task_id=STRING, keys=LONG, bytes=LONG)
SESSION = struct(start_us=LONG, end_us=LONG, worker_id=STRING, beats=LONG)
SILENCE = struct(worker_id=STRING, last_beat_us=LONG, silent_us=LONG, beats=LONG)
CONVERGENCE = struct(task_id=STRING, iteration=INT, change_count=LONG, total_keys=LONG, ts=TIME)
NODE_INFO = struct(cluster=STRING, node=STRING, section=STRING, info=STRING, keys=LONG, maxclients=INT)
