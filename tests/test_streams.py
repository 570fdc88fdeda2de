"""Folders of micro-batches: merging, replays, restarts; known keys by bucket; alarms of silent workers."""

import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.session import scratch_path
from keyferry.streaming import reports, sinks, sync
from keyferry.streaming.sinks import Batches

DRAIN = {"availableNow": True}
BEGIN = datetime.datetime(2024, 1, 1)


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(sinks, "FANOUT", 3)


def sums_of(spark, *rows):
    return spark.createDataFrame([(s, s + 10, "t", k, k) for s, k in rows], schemas.THROUGHPUT)


def test_folders_stay_few_and_rows_whole(spark, narrow):
    path = scratch_path(spark, "levels")
    table = Batches(spark, path, schemas.THROUGHPUT, reports._summed)
    expected, most = {}, 0
    for batch in range(40):
        rows = [(10 * (batch % 4), 1), (10 * batch, batch)]
        for start, keys in rows:
            expected[start] = expected.get(start, 0) + keys
        table.add(sums_of(spark, *rows).coalesce(1), "q", batch)
        most = max(most, len(table.folders()))
    found = {r.start_us: r["keys"] for r in reports.read_throughput(spark, path).collect()}
    assert found == expected and most <= 2 * 4
    # merged folders are removed, but for those that a reader may just have begun with
    files, at = table._table._files("data")
    assert len(files.listStatus(at)) <= 2 * 4 + 2 * sinks.FANOUT
    assert len(table._table.versions()) == sinks.KEPT


def test_replays_add_nothing(spark, narrow):
    path = scratch_path(spark, "replay")
    table = Batches(spark, path, schemas.THROUGHPUT, reports._summed)
    for batch in (0, 1, 1, 2, 2, 0, 3):
        table.add(sums_of(spark, (0, 1)), "q", batch)
    assert reports.read_throughput(spark, path).first()["keys"] == 4
    # a write that was cut off before the manifest named it does not count, and is replaced
    table._write(sums_of(spark, (0, 500)).withColumn("batch", F.lit(9)), "data/0-4")
    assert reports.read_throughput(spark, path).first()["keys"] == 4
    table.add(sums_of(spark, (0, 1)), "q", 4)
    # another query's micro-batches are its own
    table.add(sums_of(spark, (0, 1)), "other", 0)
    assert reports.read_throughput(spark, path).first()["keys"] == 6
    assert Batches(spark, scratch_path(spark, "none"), schemas.THROUGHPUT).read().count() == 0


def test_merged_batches_equal_the_whole(spark, narrow):
    path = scratch_path(spark, "many")
    for i in range(11):
        rows = [("t", f"w{i % 2}", 1, 10, i % 2, BEGIN + datetime.timedelta(seconds=7 * ((i * 5) % 11) + 100 * (i % 2)))]
        spark.createDataFrame(rows, schemas.PROGRESS).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def feed():
        return spark.readStream.schema(schemas.PROGRESS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    whole = spark.read.schema(schemas.PROGRESS).parquet(f"{path}/in")
    reports.stream_sessions(feed(), f"{path}/s", f"{path}/sc", trigger=DRAIN).awaitTermination()
    expected = sorted(map(str, reports.beat_sessions(whole).collect()))
    assert sorted(map(str, reports.read_sessions(spark, f"{path}/s").collect())) == expected
    reports.stream_progress(feed(), f"{path}/p", f"{path}/pc", DRAIN).awaitTermination()
    totals = {r.worker_id: (r["keys"], r["errors"]) for r in reports.read_progress(spark, f"{path}/p").collect()}
    assert totals == {"w0": (6, 0), "w1": (5, 5)}
    assert all(len(Batches(spark, f"{path}/{name}", schemas.SESSION).folders()) < 7 for name in "sp")


def test_new_keys_survive_a_new_checkpoint(spark, keyspace, narrow):
    path = scratch_path(spark, "restart")

    def run(known, checkpoint, *rows):
        keyspace(*rows).coalesce(1).write.mode("append").parquet(f"{path}/in-{checkpoint}")
        stream = spark.readStream.schema(schemas.KEYSPACE).option("maxFilesPerTrigger", 1).parquet(f"{path}/in-{checkpoint}")
        sync.stream_new_keys(stream, known, f"{path}/out", f"{path}/{checkpoint}", trigger=DRAIN).awaitTermination()
        return values(sync.read_new_keys(spark, f"{path}/out"))

    first = keyspace(("a", "0"))
    assert run(first, "one", ("a", "1"), ("b", "1")) == {"b": "1"}
    assert run(first, "one", ("b", "2"), ("c", "2")) == {"b": "1", "c": "2"}
    # a new checkpoint numbers its micro-batches from 0 again; a newer snapshot is added to the older one
    more = keyspace(("d", "0"))
    assert run(more, "two", ("a", "3"), ("b", "3"), ("c", "3"), ("d", "3"), ("e", "3")) == {"b": "1", "c": "2", "e": "3"}
    for i in range(5):
        found = run(more, "two", ("e", "4"), (f"n{i}", "4"))
    assert found == {"b": "1", "c": "2", "e": "3"} | {f"n{i}": "4" for i in range(5)}


def test_a_batch_reads_its_buckets_only(spark, keyspace):
    path = scratch_path(spark, "buckets")
    sync.add_known(keyspace(*[(f"k{i}", "v") for i in range(300)]), path)
    wanted = [r.b for r in keyspace(("k1", "v"), ("k2", "v")).select(sync.key_bucket(F.col("key")).alias("b")).collect()]
    part = sync.known_keys(spark, path, wanted)
    assert {"k1", "k2"} <= {r.key for r in part.collect()} and part.count() < 60
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in part.inputFiles()}
    everything = sync.known_keys(spark, path, list(range(sync.KEY_BUCKETS)))
    assert everything.count() == 300
    assert "PartitionFilters: [bucket" in part._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket", "bucket")
    assert files


def test_silent_workers(spark):
    path = scratch_path(spark, "silent")

    def beats(*rows):
        made = [("t", w, 1, 1, 0, BEGIN + datetime.timedelta(seconds=s)) for w, s in rows]
        spark.createDataFrame(made, schemas.PROGRESS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schemas.PROGRESS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        reports.stream_silences(stream, f"{path}/out", f"{path}/check", trigger=DRAIN).awaitTermination()
        zero = int(BEGIN.replace(tzinfo=datetime.UTC).timestamp())
        found = reports.read_silences(spark, f"{path}/out").collect()
        return sorted((r.worker_id or "", r.last_beat_us // 10**6 - zero, r.silent_us // 10**6 - zero, r.beats) for r in found)

    assert beats(("a", 0), ("a", 20), ("b", 5), (None, 1)) == []
    # time goes on by the beats of one worker: the others have been silent for long enough
    assert beats(("a", 45), ("a", 70)) == [("", 1, 31, 1), ("b", 5, 35, 1)]
    # one that comes back and falls silent again
    assert beats(("b", 80), ("a", 90), ("a", 115), ("a", 140)) == [("", 1, 31, 1), ("b", 5, 35, 1), ("b", 80, 110, 1)]
    assert beats(("b", 170), ("b", 199), ("b", 220)) == [
        ("", 1, 31, 1), ("a", 140, 170, 7), ("b", 5, 35, 1), ("b", 80, 110, 1)
    ]
