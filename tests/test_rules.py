import json

import pytest
from conftest import plan_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyferry.operators import rules
from keyferry.operators.filters import KeyFilter, filter_keys

FILTERS = {
    "all": {},
    "empty": {"mode": "prefix", "prefixes": []},
    "two": {"mode": "prefix", "prefixes": ["a", "ab", "b:1", "é"]},
    "long": {"mode": "prefix", "prefixes": ["a" * 50], "exclude_prefixes": ["a" * 51]},
    "not": {"mode": "all", "exclude_prefixes": ["a", "b:"]},
    "keys": {"mode": "keys", "keys": ["ab", "b:12", "none", "b:1"], "exclude_prefixes": ["b:12"]},
    "nothing": {"mode": "keys"},
    "unknown": {"mode": "odd", "prefixes": ["a"]},
}
KEYS = ["a", "ab", "abc", "b:1", "b:12", "b:2", "", "éa", "a" * 50, "a" * 51, "zz"]


def options(spark, filters):
    made = [(name, json.dumps({"key_filter": rule})) for name, rule in filters.items()]
    return rules.decode_options(spark.createDataFrame([*made, ("none", None), ("broken", "{x")], "id string, config string"))


def test_all_runs_at_once(spark, keyspace):
    rows = keyspace(*[(k, "v") for k in KEYS])
    found = {}
    for r in rules.keys_of_runs(rows, options(spark, FILTERS)).collect():
        found.setdefault(r.run_id, []).append(r.key)
    for name, rule in (FILTERS | {"none": {}, "broken": {}}).items():
        mode = rule.get("mode", "all")
        mode = mode if mode in ("prefix", "keys") else "all"
        include = rule.get({"prefix": "prefixes", "keys": "keys"}.get(mode, ""), [])
        alone = filter_keys(rows, KeyFilter(mode, include, rule.get("exclude_prefixes", [])))
        assert sorted(found.get(name, [])) == sorted(r.key for r in alone.collect()), name


def test_no_key_meets_every_run(spark, keyspace):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(rules.keys_of_runs(keyspace(("a", "1")), options(spark, FILTERS)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_defaults_and_patterns(spark, keyspace):
    stored = [("x", '{"conflict_policy": "replace", "skip_incremental": true}'), ("y", '{"conflict_policy": "odd"}'), ("z", None)]
    decoded = rules.decode_options(spark.createDataFrame(stored, "id string, config string"))
    assert [(r.id, r.mode, r.conflict_policy, r.skip_full_sync, r.skip_incremental) for r in decoded.orderBy("id").collect()] == [
        ("x", "all", "replace", False, True), ("y", "all", "skip_full_only", False, False), ("z", "all", "skip_full_only", False, False)
    ]
    with pytest.raises(PySparkException):
        rules.keys_of_runs(keyspace(("a", "1")), options(spark, {"p": {"mode": "pattern", "patterns": ["a"]}})).collect()
    assert rules.keys_of_runs(keyspace(("a", "1")), decoded.filter("false")).count() == 0


def test_totals_of_runs(spark, keyspace, monkeypatch):
    monkeypatch.setattr(rules, "KEY_BLOCK", 3)
    more = {
        "within": {"mode": "prefix", "prefixes": ["a", "aa"], "exclude_prefixes": ["aa", "aab", "z"]},
        "none left": {"mode": "prefix", "prefixes": ["ab"], "exclude_prefixes": ["a"]},
        "zero": {"mode": "keys", "keys": ["k", "k\0", "k"]},
        "last": {"mode": "prefix", "prefixes": ["\U0010ffff"]},
    }
    rows = keyspace(*[(k, "v") for k in [*KEYS, *KEYS, "k", "k\0", "k\0a", "aa", "aab", "aac", "\U0010ffff\U0010ffff"]], (None, "v"))
    decoded = options(spark, FILTERS | more)
    expected = {}
    for r in rules.keys_of_runs(rows, decoded).collect():
        expected.setdefault(r.run_id, []).append(r.key)
    assert all(len(keys) == len(set(keys)) for keys in expected.values())
    assert sorted(expected["within"]) == ["a", "ab", "abc"]
    assert "none left" not in expected and sorted(expected["zero"]) == ["k", "k\0"] and len(expected["last"]) == 1
    found = {r.run_id: (r["keys"], r.first_key, r.last_key) for r in rules.totals_of_runs(rows, decoded).collect()}
    assert found == {run: (len(keys), min(keys), max(keys)) for run, keys in expected.items()}


def test_totals_list_no_pairs(spark):
    # a million keys and 3,000 runs that keep nearly all: 3 * 10**9 pairs
    keys = spark.range(1_000_000).select(F.concat(F.lit("k:"), F.lpad("id", 7, "0")).alias("key"))
    number = F.col("id").cast("string")
    rule = F.struct(F.array(F.concat(F.lit("k:0"), F.lpad(number, 4, "0"))).alias("exclude_prefixes"))
    stored = F.to_json(F.struct(rule.alias("key_filter")))
    runs = spark.range(3000).select(F.concat(F.lit("r"), number).alias("id"), stored.alias("config"))
    found = rules.totals_of_runs(keys, rules.decode_options(runs))
    assert found.groupBy("keys", "last_key").count().collect() == [(999_900, "k:0999999", 3000)]
    assert [r.run_id for r in found.where("first_key <> 'k:0000000'").collect()] == ["r0"]
