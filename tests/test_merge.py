import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from keyferry.operators.filters import KeyFilter
from keyferry.operators.merge import (
    EXISTS_DETAIL,
    batch_exists,
    conflict_log,
    effective_policy,
    incremental_batch,
    merge_result,
    plan_merge,
    snapshot_diff,
)
from keyferry.operators.progress import full_load_summary, progress, throughput_eta
from keyferry.operators.verify import verify_full, verify_full_summary
from keyferry.plans.migration import MigrationOptions, migrate
from keyferry.sources.keyspace import generate_keyspace, generator_plan, scan_keyspace


@pytest.fixture
def source(keyspace):
    return keyspace(("a", "1", 60), ("b", "22"), ("c", "333"), ("gone", None))


@pytest.fixture
def target(keyspace):
    return keyspace(("b", "old", 5), ("z", "own"))


def outcomes(plan):
    return {r.key: (r.outcome, r.detail, r.bytes_moved) for r in plan.collect()}


def test_policies(source, target):
    skip = outcomes(plan_merge(source, target, "skip"))
    assert skip == {
        "a": ("migrated", None, 1),
        "b": ("skipped", EXISTS_DETAIL, 0),
        "c": ("migrated", None, 3),
        "gone": ("skipped", "vanished", 0),
    }
    assert outcomes(plan_merge(source, target, "replace"))["b"] == ("migrated", None, 2)
    assert outcomes(plan_merge(source, target, "error"))["b"] == ("failed", "key conflict", 0)
    assert outcomes(plan_merge(source, target, "skip_full_only", "full")) == skip
    assert outcomes(plan_merge(source, target, "skip_full_only", "incremental"))["b"][0] == "migrated"
    assert outcomes(plan_merge(source, target, "no such policy")) == skip
    with pytest.raises(Exception, match="key already exists: b"):
        plan_merge(source, target, "error", strict=True).collect()
    with pytest.raises(ValueError):
        effective_policy("skip", "sometimes")


def test_merged_target(source, target):
    assert values(merge_result(source, target, "skip")) == {"a": "1", "b": "old", "c": "333", "z": "own"}
    assert values(merge_result(source, target, "error")) == values(merge_result(source, target, "skip"))
    replaced = merge_result(source, target, "replace")
    assert values(replaced) == {"a": "1", "b": "22", "c": "333", "z": "own"}
    assert {r.key: r.ttl_s for r in replaced.collect()} == {"a": 60, "b": 0, "c": 0, "z": -1}


def test_replace_then_verify_finds_no_fault(source, target):
    present = source.filter(F.col("value").isNotNull())
    summary = verify_full_summary(verify_full(present, merge_result(source, target, "replace"))).first()
    assert (summary.matched_keys, summary.missing_keys, summary.mismatched_keys, summary.extra_keys) == (3, 0, 0, 1)


def test_outcomes_add_up_to_the_scan(source, target):
    rule = KeyFilter("prefix", ["a", "b"])
    row = full_load_summary(source, target, rule, "error").first()
    assert row.keys_total == source.count() == 4
    assert (row.keys_migrated, row.keys_failed, row.keys_filtered, row.keys_skipped) == (1, 1, 2, 0)


def test_incremental_twice_adds_nothing(keyspace, source, target):
    rule = KeyFilter("prefix", ["b", "c"])
    first = incremental_batch(source, keyspace(("a", "1")), target, rule)
    assert {k: v[0] for k, v in outcomes(first.plan).items()} == {"b": "migrated", "c": "migrated", "gone": "filtered"}
    assert values(first.target) == {"b": "22", "c": "333", "z": "own"}
    second = incremental_batch(source, first.known, first.target, rule)
    assert second.plan.count() == 0
    assert values(second.target) == values(first.target)


def test_conflicts_and_existence(keyspace, source, target):
    assert [r.key for r in conflict_log(plan_merge(source, target, "skip")).collect()] == ["b"]
    repeated = target.union(target)
    assert {r.key: r.exists for r in batch_exists(source.select("key"), repeated).collect()} == {
        "a": False,
        "b": True,
        "c": False,
        "gone": False,
    }
    status = {r.key: r.status for r in snapshot_diff(source.union(source), target).collect()}
    assert status == {"a": "new", "b": "common", "c": "new", "gone": "new", "z": "gone"}


def test_scan_keeps_one_row_of_a_hot_key(spark, keyspace):
    hot = spark.range(30_000).select(
        F.lit("hot").alias("key"),
        F.lit("string").alias("type"),
        F.col("id").cast("string").alias("value"),
        F.lit(-1).cast("long").alias("ttl_s"),
        (F.col("id") % 7 + 1).cast("int").alias("node"),
    )
    scanned = scan_keyspace(hot.unionByName(keyspace(("hot", "first", -1, 0), ("cold", "x"))))
    assert values(scanned) == {"hot": "first", "cold": "x"}
    assert plan_of(scanned).count("WindowGroupLimit") == 2  # cut before and after the shuffle


def test_plans_move_only_what_they_must(source, target):
    assert "Join" not in plan_of(plan_merge(source, target, "replace"))
    spread = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    session = source.sparkSession
    for name, value in spread.items():
        session.conf.set(name, value)
    try:
        plan = plan_of(merge_result(source.repartition(2), target.repartition(2), "skip"))
        assert plan.count("hashpartitioning(key") == 2 and "FullOuter" not in plan
    finally:
        for name in spread:
            session.conf.unset(name)


def test_progress_edges(spark):
    columns = "keys_total long, keys_migrated long, keys_skipped long, keys_filtered long, started_at long"
    rows = spark.createDataFrame([(0, 0, 0, 0, 5), (10, 8, 8, 0, 5), (100, 40, 0, 0, 80), (9, 9, 0, 0, 99)], columns)
    shares = [r.percentage for r in progress(rows).collect()]
    assert shares == [0.0, 100.0, 40.0, 100.0]
    timed = [(r.speed, r.eta_s, r.eta_text) for r in throughput_eta(rows, 100).collect()]
    assert timed == [(0, None, "-"), (0, None, "-"), (2, 30, "30s"), (9, None, "-")]
    with pytest.raises(ValueError):
        progress(rows, "other")


def test_whole_migration(spark, keyspace, tmp_path):
    made = generate_keyspace(generator_plan(spark, 40, 1, 5, 5, 5), string_size=50, large_size=1000, item_size=10)
    report = migrate(
        spark, made.union(made), keyspace(("str_key_3", "kept")), str(tmp_path / "v2"), MigrationOptions(sample=1000)
    )
    summary = report.summary.first()
    assert (summary.keys_total, summary.keys_migrated, summary.keys_skipped, summary.percentage) == (56, 55, 1, 100.0)
    checked = report.verification.first()
    assert (checked.total_keys, checked.matched_keys, checked.mismatched_keys) == (56, 55, 1)
    assert "PartitionFilters: [isnotnull(slot_bucket" in plan_of(report.target.filter("slot_bucket = 3"))
    with pytest.raises(Exception, match="already exists"):
        migrate(spark, made, keyspace(("a", "b")), str(tmp_path / "v2"))


def test_rows_with_values_are_not_sorted(spark, keyspace):
    source = keyspace(("a", "1"), ("b", "2"), ("c", None), ("d", "4"))
    target = keyspace(("b", "old"), ("z", "own"), (None, "odd"))
    known = keyspace(("a", "0"), ("a", "1"), (None, "0"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = incremental_batch(source, known, target)
        plans = [plan_of(batch.target), plan_of(merge_result(source, target)), plan_of(merge_result(source, target, "replace"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("Sort [" not in plan and "SortMergeJoin" not in plan for plan in plans)
    assert values(batch.target) == {"b": "2", "d": "4", "z": "own", None: "odd"}
    assert values(merge_result(source, target)) == {"a": "1", "b": "old", "d": "4", "z": "own", None: "odd"}
