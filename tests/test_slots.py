import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.functions.slots import SLOT_COUNT, slot, slot_bucket
from keyferry.operators import slots


def slot_by_hand(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x1021 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc % SLOT_COUNT


def slots_of(spark, keys, strict=False):
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", slot(F.col("key"), strict).alias("slot"))
    return {r.key: r.slot for r in rows.collect()}


def test_known_slots(spark):
    known = {"123456789": 12739, "foo{bar}baz": 5061, "a{}b": 0, "a{b": 13340}
    assert slots_of(spark, known) == known


def test_tags(spark):
    found = slots_of(spark, ["a{}b", "x}{t}", "{t}", "t", "{a}{b}", "a", "{{t}}", "{t"])
    assert found["{t}"] == found["t"] == found["x}{t}"]
    assert found["{a}{b}"] == found["a"]
    assert found["{{t}}"] == slot_by_hand(b"{t")
    assert slots_of(spark, ["a{}b"], strict=True)["a{}b"] == slot_by_hand(b"a{}b")


def test_any_bytes_match_a_bitwise_crc(spark):
    rng = random.Random(7)
    alphabet = "abcXYZ0129:_-é漢字🙂 \n"
    keys = {"".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 40, 3000]))) for _ in range(400)}
    assert slots_of(spark, keys) == {k: slot_by_hand(k.encode()) for k in keys}


def test_null_key(spark, keyspace):
    assert slots_of(spark, [None, "a"])[None] == -1
    ranges = spark.createDataFrame([("t", "w", 0, 16383)], "task_id string, worker_id string, slot_start int, slot_end int")
    assert slots.range_workload(keyspace((None, "x"), ("a", "y")), ranges).first()["keys"] == 1


def test_joins_run_the_udf_once(spark, keyspace, tmp_path):
    keyspace(("a", "1")).write.parquet(str(tmp_path / "rows"))
    stored = spark.read.schema(schemas.KEYSPACE).parquet(str(tmp_path / "rows"))
    ranges = spark.createDataFrame([("t", "w", 0, 16383)], "task_id string, worker_id string, slot_start int, slot_end int")
    joined = slots.slot_histogram(stored).join(ranges, F.col("slot") == F.col("slot_start"))
    assert plan_of(joined).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("workers", [1, 3, 7, 1000, SLOT_COUNT])
def test_ranges_cover_every_slot_once(spark, workers):
    plan = spark.createDataFrame([("t", workers)], "task_id string, workers int")
    ranges = sorted((r.slot_start, r.slot_end) for r in slots.slot_ranges(plan).collect())
    assert len(ranges) == workers and ranges[0][0] == 0 and ranges[-1][1] == SLOT_COUNT - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("workers", [0, SLOT_COUNT + 1])
def test_worker_count_is_checked(spark, workers):
    plan = spark.createDataFrame([("t", workers)], "task_id string, workers int")
    with pytest.raises(Exception, match="workers must lie in"):
        slots.slot_ranges(plan).collect()


def test_workload_of_empty_and_overlapping_ranges(spark, keyspace):
    rows = keyspace(("{foo}1", "ab"), ("{foo}2", "c"))
    ranges = spark.createDataFrame(
        [("t", "all", 0, 16383), ("t", "upper", 8192, 16383), ("t", "none", 5, 4)],
        "task_id string, worker_id string, slot_start int, slot_end int",
    )
    found = {r.worker_id: (r["keys"], r["bytes"]) for r in slots.range_workload(rows, ranges).collect()}
    assert found == {"all": (2, 3), "upper": (2, 3), "none": (0, 0)}  # foo lies in slot 12182


def test_buckets_are_contiguous(spark):
    rows = spark.range(SLOT_COUNT).select("id", slot_bucket(F.col("id"), 64).alias("bucket"))
    widths = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id"), F.max("id")).collect()
    assert len(widths) == 64 and {w.n for w in widths} == {256}
    with pytest.raises(ValueError):
        slot_bucket(F.col("id"), 0)


def test_slot_of_bytes_that_are_no_text(spark):
    key = F.expr("cast(X'FF41' AS string)")
    assert spark.range(1).select(slot(key).alias("s")).first().s == 6938
