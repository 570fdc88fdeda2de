import datetime

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.operators import merge, verify
from keyferry.session import scratch_path
from keyferry.sources import logs, writers
from keyferry.sources.keyspace import key_snapshot, keyspace_size, read_keyspace, union_scans
from keyferry.streaming import reports, sync
from keyferry.streaming.sinks import read_batches

NOW = "2024-02-01 00:00:00"
DRAIN = {"availableNow": True}


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_formats(spark, keyspace, tmp_path, fmt):
    rows = keyspace(("a", "1", 5), ("b", "two words"))
    rows.write.format(fmt).save(str(tmp_path / fmt))
    assert read_keyspace(spark, str(tmp_path / fmt), fmt).orderBy("key").collect() == rows.orderBy("key").collect()


def test_sizes_and_snapshots(keyspace):
    rows = keyspace(("a", "1", -1, 0), ("a", "2", -1, 1), ("b", "3", -1, 1))
    assert {r.node: r["keys"] for r in keyspace_size(rows).collect()} == {0: 1, 1: 2, None: 3}
    assert key_snapshot(rows).count() == 2
    assert union_scans(rows, keyspace(("c", "1"), ("a", "9"))).count() == 3


def test_log_text_round_trip(spark, tmp_path):
    rows = [
        (1, "2024-01-01 10:00:00.001", "INFO", "started", "main.go:1", None, None, None, None),
        (2, "2024-01-01 10:00:00.002", "ERROR", "bad {brace", "x.go:2", "0123456789", "abcdefghij", '{"k":"v"}', "at x\nat y"),
        (3, "2024-01-01 10:00:00.003", "WARN", "no source", None, None, "abcdefghij", None, None),
    ]
    table = spark.createDataFrame(rows, schemas.LOG)
    writers.export_logs_text(table, str(tmp_path / "text"), NOW, level="all")
    lines = [r.value for r in spark.read.text(str(tmp_path / "text"), wholetext=False).collect()]
    assert "Total Entries: 3" in lines and "Stack Trace:" in lines
    parsed = logs.read_log_text(spark, str(tmp_path / "text")).orderBy("timestamp").collect()
    assert [(r.level, r.request_id, r.task_id, r.source, r.message, r.fields) for r in parsed] == [
        ("INFO", None, None, "main.go:1", "started", None),
        ("ERROR", "0123456789", "abcdefghij", "x.go:2", "bad {brace", '{"k":"v"}'),
        ("WARN", None, "abcdefghij", None, "no source", None),
    ]
    newest = [r.value for r in writers.log_export_lines(table, NOW).collect()]
    assert newest[0].startswith(logs.EXPORT_TITLE) and "no source" in newest[1]


@pytest.mark.parametrize("end", ["\u0085", "\u2028", "\u2029", "\x0b", "é"])
def test_messages_keep_their_last_character(spark, end):
    line = f"[2024-01-01 10:00:00.001] [INFO] done{end}"
    row = logs.scan_log_text(spark.createDataFrame([(line,)], "value string")).first()
    assert row.message == f"done{end}" and row.fields is None


def test_error_key_csv(spark, tmp_path):
    rows = [("t", 1, 'quo"ted,\nkey', "hash", "failed", 'say "no"', NOW)]
    writers.export_error_keys_csv(spark.createDataFrame(rows, schemas.ERROR_KEY).coalesce(1), str(tmp_path / "csv"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "csv"), wholetext=True).collect())
    assert text == f'"Key","Type","Reason","Detail","Timestamp"\n"quo""ted,\nkey","hash","failed","say ""no""","{NOW}"\n'


def test_bucketed_snapshots_join_without_shuffle(spark, keyspace, tmp_path):
    rows = keyspace(*[(f"k{i}", "v") for i in range(50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sides = []
        for name in ("source_v1", "target_v1"):
            writers.write_snapshot_table(rows, name, str(tmp_path / name), buckets=4)
            sides.append(spark.table(name))
        checked = verify.verify_full(*sides)
        plans = [plan_of(df) for df in (checked, merge.merge_result(*sides, "skip"), merge.plan_merge(*sides, "skip"))]
        assert all("Exchange" not in plan for plan in plans)
        assert verify.verify_full_summary(checked).first().matched_keys == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("source_v1", "target_v1"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_metrics_append(spark, tmp_path):
    points = spark.createDataFrame([("t", "speed", 1.5, 10)], schemas.METRIC)
    for _ in range(2):
        writers.append_metrics(points, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_new_keys_stream_is_idempotent(spark, keyspace):
    path = scratch_path(spark, "new")
    known = keyspace(("a", "0"))

    def run():
        rows = spark.readStream.schema(schemas.KEYSPACE).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        sync.stream_new_keys(rows, known, f"{path}/out", f"{path}/check", trigger=DRAIN).awaitTermination()
        return values(sync.read_new_keys(spark, f"{path}/out"))

    keyspace(("a", "1"), ("b", "1"), ("c", "1")).coalesce(1).write.parquet(f"{path}/in")
    assert run() == {"b": "1", "c": "1"}
    keyspace(("b", "2"), ("d", "2"), ("a", "2")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    assert run() == {"b": "1", "c": "1", "d": "2"} == run()


def test_progress_stream_keeps_the_newest_totals(spark):
    path = scratch_path(spark, "progress")
    begin = datetime.datetime(2024, 1, 1)
    for step in range(3):
        rows = [("t", f"w{i}", 10, 100, 1, begin + datetime.timedelta(seconds=step)) for i in range(step + 1)]
        spark.createDataFrame(rows, schemas.PROGRESS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schemas.PROGRESS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    reports.stream_progress(stream, f"{path}/out", f"{path}/check", DRAIN).awaitTermination()
    totals = {r.worker_id: r["keys"] for r in reports.read_progress(spark, f"{path}/out").collect()}
    assert totals == {"w0": 30, "w1": 20, "w2": 10}
    assert read_batches(spark, f"{path}/out", schemas.PROGRESS_TOTALS).agg(F.max("batch")).first()[0] >= 2


def test_late_reports_and_open_windows_are_kept(spark):
    path = scratch_path(spark, "windows")
    begin = datetime.datetime(2024, 1, 1)
    # one file and micro-batch each, out of order
    for worker, second in [("w", s) for s in (200, 9, 70, 0, 25, 10)] + [(None, 40), (None, 5), (None, 22)]:
        rows = [("t", worker, 1, 10, 0, begin + datetime.timedelta(seconds=second))]
        spark.createDataFrame(rows, schemas.PROGRESS).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def feed():
        return spark.readStream.schema(schemas.PROGRESS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    whole = spark.read.schema(schemas.PROGRESS).parquet(f"{path}/in")
    for slide in (None, "5 seconds"):
        out = f"{path}/sums-{slide is None}"
        reports.stream_throughput(feed(), out, f"{out}-check", slide, DRAIN).awaitTermination()
        found = sorted(map(tuple, reports.read_throughput(spark, out).collect()))
        assert found == sorted(map(tuple, reports.window_sums(whole, slide).collect()))
    reports.stream_sessions(feed(), f"{path}/sessions", f"{path}/check", trigger=DRAIN).awaitTermination()
    expected = sorted(map(str, reports.beat_sessions(whole).collect()))
    assert sorted(map(str, reports.read_sessions(spark, f"{path}/sessions").collect())) == expected
    parts = read_batches(spark, f"{path}/sessions", schemas.SESSION).drop("batch")
    short = reports.merge_sessions(parts, chunk_us=15_000_000)  # sessions over several chunks
    assert sorted(map(str, short.collect())) == expected and len(expected) == 4
