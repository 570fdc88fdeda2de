import pytest

from keyferry import schemas
from keyferry.operators import history
from keyferry.operators.clusters import cluster_summary, recommend_config
from keyferry.operators.largekeys import large_key_progress, large_keys, split_large_values
from keyferry.sources.nodes import scan_node_info
from pyspark.sql import functions as F


def test_attempts(spark):
    rows = [
        ("t", "first", 1, "ok"),
        ("t", "third", 1, "failed"),
        ("t", "third", 2, "failed"),
        ("t", "third", 3, "ok"),
        ("t", "late", 4, "ok"),
        *[("t", "late", i, "failed") for i in (1, 2, 3)],
        ("t", "skip", 1, "failed"),
        ("t", "skip", 2, "skipped"),
        ("t", "skip", 2, "skipped"),
    ]
    attempts = spark.createDataFrame(rows, "task_id string, key string, attempt int, outcome string")
    found = {r.key: (r.outcome, r.attempts, r.waited_ms, r.detail) for r in history.resolve_attempts(attempts).collect()}
    assert found == {
        "first": ("ok", 1, 0, None),
        "third": ("ok", 3, 300, None),
        "late": ("failed", 3, 300, "(after 3 retries)"),
        "skip": ("skipped", 2, 100, None),
    }
    slow = history.resolve_attempts(attempts, "incremental").filter("key = 'third'").first()
    assert slow.waited_ms == 3000
    assert [r.key for r in history.dead_letters(history.resolve_attempts(attempts)).collect()] == ["late"]


@pytest.fixture
def runs(spark):
    rows = [(f"r{i}", "running" if i == 0 else "completed", i) for i in range(45)]
    return spark.createDataFrame(rows, "id string, status string, created_at long")


def test_retention(spark, runs):
    assert {r.id for r in history.retain_runs(runs).collect()} == {"r44", "r43", "r42", "r0"}
    children = spark.createDataFrame([("r0",), ("r1",), ("r44",), (None,)], "task_id string")
    kept = history.cascade_delete(history.dropped_runs(runs), {"c": children})["c"]
    assert {r.task_id for r in kept.collect()} == {"r0", "r44", None}


def test_pages(runs):
    page = history.list_runs(runs, page=-3, size=1000).collect()
    assert [r.id for r in page] == [f"r{i}" for i in range(44, -1, -1)] and page[0].total == 45
    with pytest.raises(ValueError, match="one run at least"):
        history.list_runs(runs, size=0)
    assert [r.id for r in history.list_runs(runs, "completed", 3, 20).collect()] == [f"r{i}" for i in range(4, 0, -1)]


def test_resume(spark):
    ranges = spark.createDataFrame([("t", "w0", 0, 3)], schemas.SLOT_RANGE)
    rows = [
        ("t", "w0", 0, "0", 5, 1, "k", 10, 1),
        ("t", "w0", 1, "0", 5, 1, "k", 10, 1),
        ("t", "w0", 1, "77", 6, 1, "k", 10, 2),  # written later: not finished
        ("t", "w0", 2, "0", 0, 0, "k", 10, 1),  # nothing migrated yet
    ]
    left = history.resume_slots(ranges, spark.createDataFrame(rows, schemas.CHECKPOINT))
    assert sorted(r.slot for r in left.collect()) == [1, 2, 3]


def test_error_rows(spark):
    rows = [("t", i, f"k{i}", "string", "failed" if i % 3 else "skipped", "d", "x") for i in range(2500)]
    errors = spark.createDataFrame(rows, schemas.ERROR_KEY)
    assert history.shown_error_keys(errors).agg(F.max("seq"), F.count("*")).first() == (99, 100)
    assert history.cap_error_keys(errors, 2000).agg(F.max("seq"), F.count("*")).first() == (1999, 2000)
    stats = history.error_key_stats(errors).first()
    assert (stats.total, stats.failed, stats.skipped, stats.large_keys) == (2500, 1666, 834, 0)


def test_node_reports(spark):
    rows = [
        ("c", "n1", "server", "# Server\r\nredis_version:7.0.1\r\n", 10, 100),
        ("c", "n1", "memory", "used_memory_human:9\r\n  used_memory:4096  \r\nmaxmemory:abc\r\n", None, None),
        ("c", "n2", "stats", "instantaneous_ops_per_sec:5\nconnected_clients:7", 0, 50),
        ("d", "n3", "stats", None, None, None),
    ]
    nodes = scan_node_info(spark.createDataFrame(rows, schemas.NODE_INFO))
    found = {r.node: (r["keys"], r.version, r.used_memory, r.max_memory, r.ops, r.clients) for r in nodes.collect()}
    assert found == {
        "n1": (10, "7.0.1", 4096, 0, 0, 0),
        "n2": (0, "unknown", 0, 0, 5, 7),
        "n3": (0, "unknown", 0, 0, 0, 0),
    }
    summary = {r.cluster: r for r in cluster_summary(nodes).collect()}
    assert (summary["c"].nodes, summary["c"].avg_key_bytes, summary["c"].version) == (2, 409, "7.0.1")
    assert summary["d"].avg_key_bytes == 0
    pairs = spark.createDataFrame([("c", "d")], "source string, target string")
    advice = recommend_config(cluster_summary(nodes), pairs, cores=64).first()
    assert (advice.workers, advice.source_qps, advice.speed, advice.seconds) == (33, 0, 16500, 0)
    assert (advice.source_connections, advice.target_connections) == (50, 50)


def test_parts(spark, keyspace):
    rows = keyspace(("big", "héllo wörld " * 50), ("small", "x"), ("exact", "a" * 200))
    parts = split_large_values(rows, 100, 100).persist()
    joined = parts.groupBy("key").agg(F.sum("part_bytes").alias("n"), F.max("total_bytes").alias("t"), F.count("*").alias("c"))
    assert {r.key: (r.n, r.t, r.c) for r in joined.collect()} == {"big": (700, 700, 7), "exact": (200, 200, 2)}
    whole = {r.key: r.status for r in large_key_progress(parts, parts.union(parts)).collect()}
    assert whole == {"big": "done", "exact": "done"}
    spoiled = parts.filter("part_no > 0").withColumn("data", F.when(F.col("key") == "exact", F.lit(b"?")).otherwise(F.col("data")))
    some = {r.key: (r.status, r.transferred_bytes) for r in large_key_progress(parts, spoiled).collect()}
    assert some == {"big": ("partial", 600), "exact": ("pending", 0)}
    assert [r.key for r in large_keys(rows, 200).collect()] == ["big", "exact"]
    assert [r.key for r in large_keys(rows, 1, top=1).collect()] == ["big"]
