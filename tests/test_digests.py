import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from keyferry.functions.slots import slot
from keyferry.operators import digests, verify


def tables(*sides):
    return [digests.stored_digests(digests.digest_rows(side), buckets=16) for side in sides]


@pytest.fixture(scope="module")
def sides():
    """Keys of either side: some stale, lost or own, a hot slot, null values."""
    rng = random.Random(6)
    source = {f"k{i}": f"v{i}" for i in range(3000)} | {f"{{hot}}{i}": "x" for i in range(2000)}
    source["empty"], source["none"] = "", None
    target = dict(source)
    for key in rng.sample(sorted(source), 25):
        target.pop(key)
    for key in rng.sample(sorted(target), 25):
        target[key] = "stale"
    target["own"] = "1"
    target["{hot}own"] = None
    target["none"] = ""
    return source, target


def expected_of(source, target):
    def status(key):
        if key not in source:
            return "extra"
        return "missing" if key not in target else "matched" if source[key] == target[key] else "mismatched"

    return {key: status(key) for key in source.keys() | target.keys()}


def found_of(rows):
    rows = rows.collect()
    found = {r.key: r.status for r in rows}
    assert len(found) == len(rows)
    return found


def test_tree_equals_full_check(keyspace, sides):
    source, target = sides
    stored = tables(*[keyspace(*side.items()) for side in sides])
    expected = expected_of(source, target)
    assert found_of(digests.compare_digests(*stored)) == expected
    faults = {k: s for k, s in expected.items() if s != "matched"}
    assert found_of(digests.compare_digests(*stored, with_matched=False)) == faults
    plain = [digests.digest_rows(keyspace(*side.items())) for side in sides]
    assert found_of(digests.compare_digests(*plain)) == expected
    hashed = [digests.digest_rows(keyspace(*side.items()), hashed=True) for side in sides]
    assert found_of(digests.compare_digests(*hashed)) == expected
    full = verify.verify_full(*[keyspace(*side.items()) for side in sides])
    assert found_of(full) == expected


def test_only_differing_parts_meet(spark, keyspace, sides):
    source, target = sides
    stored = tables(*[keyspace(*side.items()) for side in sides])
    faults = [k for k, s in expected_of(source, target).items() if s != "matched"]
    keys = spark.createDataFrame([(k,) for k in faults], "key string")
    slots = {r.s for r in keys.select(slot(keys.key).alias("s")).collect()}
    assert {r.slot for r in digests.differing_slots(*stored).collect()} == slots
    parts = digests.differing_parts(*stored).collect()
    assert {r.slot for r in parts} == slots and sum(len(r.parts) for r in parts) <= len(faults)
    plan = plan_of(digests.compare_digests(*stored, with_matched=False))
    # buckets without a differing slot are not read
    assert "dynamicpruning" in plan


def test_alike_and_empty_sides(keyspace):
    rows, none = keyspace(("a", "1"), ("b", None)), keyspace(("a", "1")).filter("false")
    assert found_of(digests.compare_digests(*tables(rows, rows))) == {"a": "matched", "b": "matched"}
    assert digests.compare_digests(*tables(rows, rows), with_matched=False).count() == 0
    assert found_of(digests.compare_digests(*tables(rows, none))) == {"a": "missing", "b": "missing"}
    assert found_of(digests.compare_digests(*tables(none, rows))) == {"a": "extra", "b": "extra"}
    assert digests.compare_digests(*tables(none, none)).count() == 0


def test_types_count(keyspace):
    other = keyspace(("a", "1")).replace("string", "hash", "type")
    assert found_of(digests.compare_digests(*tables(keyspace(("a", "1")), other))) == {"a": "mismatched"}


def test_two_levels_do_not_shuffle_by_group(keyspace, sides):
    source, target = [keyspace(*side.items()) for side in sides]
    plan = plan_of(verify.verify_two_level(source, target, F.substring("key", 1, 2), 1000))
    assert "hashpartitioning(key" in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning(substr" in line:
            # by group only counts move
            assert "partial_count" in plan.splitlines()[plan.splitlines().index(line) + 1]
