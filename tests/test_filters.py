import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from keyferry.operators.filters import KeyFilter, filter_keys, filter_report, filter_verdict, select_in_slots
from keyferry.sources.keyspace import read_key_list, read_keyspace

KEYS = ["user:1", "user:2", "order:1", "order:22", "tmp:user:9", "cache"]


@pytest.fixture
def rows(keyspace):
    return keyspace(*[(k, "v") for k in KEYS])


def kept(rows, rule):
    return {r.key for r in filter_keys(rows, rule).collect()}


def test_modes(spark, rows):
    assert kept(rows, KeyFilter()) == set(KEYS)
    assert kept(rows, KeyFilter("prefix")) == set(KEYS)
    assert kept(rows, KeyFilter("prefix", ["user:"])) == {"user:1", "user:2"}
    assert kept(rows, KeyFilter("pattern", ["user", "2$"])) == {"user:1", "user:2", "tmp:user:9", "order:22"}
    assert kept(rows, KeyFilter("contains", ["r:2"])) == {"user:2", "order:22"}
    assert kept(rows, KeyFilter("contains", ["$"])) == set()
    assert kept(rows, KeyFilter("keys")) == set()
    listed = spark.createDataFrame([("order:1",), ("order:1",), ("nowhere",)], "key string")
    assert kept(rows, KeyFilter("keys", ["cache"], key_table=listed)) == {"cache", "order:1"}


def test_exclusions_come_first_in_every_mode(spark, rows):
    table = spark.createDataFrame([("user:1",)], "key string")
    rules = dict(exclude_prefixes=["tmp:"], exclude_patterns=["2$"], exclude_table=table)
    assert kept(rows, KeyFilter(**rules)) == {"order:1", "cache"}
    assert kept(rows, KeyFilter("pattern", ["user"], **rules)) == set()
    assert kept(rows, KeyFilter("keys", ["tmp:user:9", "cache"], **rules)) == {"cache"}


@pytest.mark.parametrize("mode", ["all", "prefix", "pattern", "contains", "keys"])
def test_verdict_agrees_with_filter(spark, rows, mode):
    table = spark.createDataFrame([("order:22",)], "key string")
    rule = KeyFilter(mode, ["user:", "cache"], ["tmp"], ["1$"], exclude_table=table)
    verdict = filter_verdict(rows, rule)
    assert {r.key for r in verdict.filter("kept").collect()} == kept(rows, rule)
    report = filter_report(rows, rule)
    assert report.agg(F.sum("keys")).first()[0] == len(KEYS)


def test_key_list_file(spark, rows, tmp_path):
    (tmp_path / "keys.txt").write_text("cache\n\nuser:2\n")
    listed = read_key_list(spark, str(tmp_path / "keys.txt"))
    assert kept(rows, KeyFilter("keys", key_table=listed)) == {"cache", "user:2"}


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="invalid pattern"):
        KeyFilter("pattern", ["("])
    with pytest.raises(ValueError, match="invalid pattern"):
        KeyFilter(exclude_patterns=["["])
    with pytest.raises(ValueError, match="mode"):
        KeyFilter("glob")


def test_prefixes_and_lists_reach_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "keys")
    rows.write.parquet(path)
    stored = read_keyspace(spark, path)
    pushed = plan_of(filter_keys(stored, KeyFilter("prefix", ["user:", "order:"])).select("key", "value"))
    assert "StringStartsWith(key,user:)" in pushed and "ReadSchema: struct<key:string,value:string>" in pushed
    assert "In(key, [a,b])" in plan_of(filter_keys(stored, KeyFilter("keys", ["a", "b"])))


def test_slots(rows):
    foo = rows.withColumn("key", F.concat(F.lit("{foo}"), "key"))
    assert select_in_slots(foo, 12182).count() == len(KEYS)
    assert select_in_slots(foo, 0, 12181).count() == 0


def test_patterns_of_the_engine_that_matches(keyspace):
    rows = keyspace(("abc", "1"), ("12", "2"), ("ab\n", "3"))
    assert kept(rows, KeyFilter("pattern", [r"^\p{L}+\z"])) == {"abc"}
