import pytest
from conftest import values
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.functions.slots import slot, slot_bucket
from keyferry.operators import filters, merge
from keyferry.sources import versions, writers
from keyferry.sources.manifest import Manifests


def files_of(df):
    return {f.split("/data/")[1] for f in df.inputFiles()}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "space")


def rows_of(df):
    return sorted(map(tuple, df.select(schemas.KEYSPACE.names).collect()))


@pytest.mark.parametrize("policy", ["skip", "replace", "error"])
def test_a_merge_writes_changed_buckets_only(spark, keyspace, path, policy):
    target = keyspace(*[(f"k{i}", f"v{i}", i) for i in range(400)])
    assert versions.write_version(target, path, 16) == 0
    before = versions.read_version(spark, path)
    assert rows_of(before) == rows_of(target)
    # two new keys, one other value, one equal row, one key that has vanished
    source = keyspace(("n1", "new", 5), ("n2", "new"), ("k1", "other"), ("k2", "v2", 2), ("gone", None))
    assert versions.merge_version(source, path, policy) == 1
    after = versions.read_version(spark, path)
    assert rows_of(after) == rows_of(merge.merge_result(source, target, policy))
    changed = ["n1", "n2"] + (["k1"] if policy == "replace" else [])
    keys = spark.createDataFrame([(k,) for k in changed], "key string")
    buckets = {r.b for r in keys.select(slot_bucket(slot(keys.key), 16).alias("b")).collect()}
    rewritten = {int(f.split("slot_bucket=")[1].split("/")[0]) for f in files_of(after) - files_of(before)}
    assert rewritten == buckets and len(buckets) < 4
    # the older version can still be read
    assert rows_of(versions.read_version(spark, path, 0)) == rows_of(target)
    # nothing to change: the next version has the same files
    assert versions.merge_version(source, path, policy) == 2
    assert files_of(versions.read_version(spark, path)) == files_of(after)
    versions.expire_versions(spark, path, 1)
    assert Manifests(spark, path).versions() == [2] and rows_of(versions.read_version(spark, path)) == rows_of(after)


def test_slots_of_a_version(spark, keyspace, path):
    rows = keyspace(*[(f"k{i}", "v") for i in range(500)])
    versions.write_version(rows, path, 16)
    for first, last in ((0, 16383), (1024, 2047), (1000, 5000), (7, 7), (16000, 16383)):
        part = versions.read_version(spark, path, slots=(first, last))
        assert rows_of(part) == rows_of(filters.select_in_slots(rows, first, last))
        buckets = {int(f.split("slot_bucket=")[1].split("/")[0]) for f in files_of(part)}
        assert buckets <= set(range(first // 1024, last // 1024 + 1))


def test_empty_and_missing_versions(spark, keyspace, path):
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    none = keyspace(("a", "1")).filter("false")
    versions.write_version(none, path, 4)
    assert versions.read_version(spark, path).count() == 0
    versions.merge_version(keyspace(("a", "1")), path)
    assert values(versions.read_version(spark, path)) == {"a": "1"}


def test_two_writers_of_one_version(spark, keyspace, path):
    versions.write_version(keyspace(("a", "1")), path, 4)
    with pytest.raises(RuntimeError):
        Manifests(spark, path).commit({"buckets": 4, "folders": {}}, 0)


def test_snapshot_buckets_are_pruned(spark, keyspace, tmp_path):
    rows = keyspace(*[(f"k{i}", "v") for i in range(500)])
    writers.write_snapshot(rows, str(tmp_path / "s"), 16)
    stored = spark.read.parquet(str(tmp_path / "s"))
    part = filters.select_in_slots(stored, 1000, 5000, buckets=16)
    assert rows_of(part) == rows_of(filters.select_in_slots(rows, 1000, 5000))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot_bucket" in plan
    one = filters.select_in_slots(stored, 3, buckets=16)
    assert rows_of(one) == rows_of(filters.select_in_slots(rows, 3)) and one.filter(F.col("slot_bucket") > 0).count() == 0
