import hashlib

from conftest import plan_of
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.operators import verify


def statuses(df):
    return {r.key: r.status for r in df.collect()}


def test_statuses(keyspace):
    source = keyspace(("same", "1", 5), ("other", "2"), ("lost", "3"), ("ttl", "4", 60))
    target = keyspace(("same", "1", 5), ("other", "x"), ("own", "9"), ("ttl", "4", 61))
    expected = {"same": "matched", "other": "mismatched", "lost": "missing", "ttl": "matched"}
    assert statuses(verify.verify_rows(source, target)) == expected
    assert statuses(verify.verify_rows(source, target, compare_ttl=True)) == {**expected, "ttl": "mismatched"}
    assert statuses(verify.verify_rows(source, target, sample_size=4)) == expected
    assert statuses(verify.verify_full(source, target)) == {**expected, "own": "extra"}


def test_empty_source_has_rate_zero(keyspace):
    rows = keyspace(("a", "1"))
    row = verify.verify_summary(verify.verify_rows(rows.filter("false"), rows)).first()
    assert (row.total_keys, row.consistency_rate) == (0, 0.0)


def test_null_values_compare(keyspace):
    assert statuses(verify.verify_rows(keyspace(("a", None)), keyspace(("a", None)))) == {"a": "matched"}
    assert statuses(verify.verify_rows(keyspace(("a", None)), keyspace(("a", "x")))) == {"a": "mismatched"}


def test_sample_is_the_first_by_digest(spark, keyspace):
    keys = [f"k{i}" for i in range(3000)]
    rows = keyspace(*[(k, "v") for k in keys])
    ordered = sorted(keys, key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))
    for n in (1, 7, 1500, 5000):
        assert {r.key for r in verify.sample_keys(rows, n).collect()} == set(ordered[:n])


def test_two_levels_check_failing_groups_whole(keyspace):
    source = keyspace(*[(f"g{i % 4}:{i}", "v") for i in range(40)])
    target = source.filter("key != 'g1:5'").withColumn("value", F.when(F.col("key") == "g1:9", "w").otherwise("v"))
    target = target.unionByName(keyspace(("g1:x", "own"), ("g2:x", "own")))
    found = verify.verify_two_level(source, target, F.substring("key", 1, 2), 40).collect()
    assert {(r.group, r.level) for r in found} == {(f"g{i}", 1) for i in range(4)} | {("g1", 2)}
    second = next(r for r in found if r.level == 2)
    assert (second.total_keys, second.matched_keys, second.mismatched_keys, second.missing_keys, second.extra_keys) == (
        10,
        8,
        1,
        1,
        1,
    )


def test_canonical_values_ignore_only_free_order(spark):
    def row(key, kind, str=None, hash=None, list=None, set=None, zset=None):
        return (key, kind, str, hash, list, set, zset)

    rows = [
        row("h1", "hash", hash={"a": "1", "b": "2"}),
        row("h2", "hash", hash={"b": "2", "a": "1"}),
        row("s1", "set", set=["x", "y"]),
        row("s2", "set", set=["y", "x"]),
        row("l1", "list", list=["x", "y"]),
        row("l2", "list", list=["y", "x"]),
        row("l3", "list", list=['x","y']),
        row("l4", "list", list=["x", "y"][:1] + ["y"]),
        row("z1", "zset", zset=[("m", 2), ("n", 1)]),
        row("z2", "zset", zset=[("n", 1), ("m", 2)]),
        row("z3", "zset", zset=[("n", 2), ("m", 1)]),
        row("t", "string", str="plain"),
    ]
    made = verify.canonical_values(spark.createDataFrame(rows, schemas.TYPED))
    text = {r.key: r.value for r in made.collect()}
    assert text["h1"] == text["h2"] == '[{"key":"a","value":"1"},{"key":"b","value":"2"}]'
    assert text["s1"] == text["s2"] and text["z1"] == text["z2"] == '[{"score":1,"member":"n"},{"score":2,"member":"m"}]'
    assert text["l1"] == text["l4"] != text["l2"] and text["l1"] != text["l3"] and text["z1"] != text["z3"]
    assert text["t"] == "plain"


def test_only_digests_are_shuffled(spark, keyspace, tmp_path):
    path = str(tmp_path / "rows")
    keyspace(("a", "1")).write.parquet(path)
    stored = spark.read.schema(schemas.KEYSPACE).parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(verify.verify_full(stored, stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan.split("Exchange hashpartitioning")[1].splitlines()[1]
    assert "md5" in below
    assert "BroadcastHashJoin" in plan_of(verify.verify_rows(verify.sample_keys(stored, 10), stored, sample_size=10))
