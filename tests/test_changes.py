import datetime
import random

import pytest
from conftest import plan_of

from keyferry import schemas
from keyferry.operators import renames as renames_module
from keyferry.operators.changes import apply_changes, fold_changes, merge_folds
from keyferry.session import scratch_path
from keyferry.sources.changes import change_feed
from keyferry.streaming import sync

START = datetime.datetime(2024, 1, 1)


def events(spark, *rows):
    """Rows (second, offset, op, key, value, ttl_s, new_key)."""
    filled = [
        ("n", key, op, value, ttl, new, START + datetime.timedelta(seconds=second), offset)
        for second, offset, op, key, value, ttl, new in rows
    ]
    return spark.createDataFrame(filled, schemas.CHANGE)


def replay(base: dict, rows) -> dict:
    """Apply set, del, expire and rename events one by one in order. Renaming an absent key changes nothing."""
    state = dict(base)
    for second, offset, op, key, value, ttl, new in sorted(set(rows), key=lambda r: (r[0], r[1])):
        if op == "set":
            state[key] = (value, ttl)
        elif op == "del":
            state.pop(key, None)
        elif op == "rename":
            if key in state:
                state[new] = state.pop(key)
        elif key in state:
            state[key] = (state[key][0], ttl)
    return state


@pytest.fixture
def log():
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(12)] + ["hot"] * 6
    return [
        (rng.randrange(200), i, rng.choice(["set", "set", "del", "expire"]), rng.choice(keys), f"v{i}", i + 1, None)
        for i in range(400)
    ]


def state_of(df):
    return {r.key: (r.value, r.ttl_s) for r in df.collect()}


def test_fold_equals_replay(spark, keyspace, log):
    base = keyspace(*[(f"k{i}", "base") for i in range(0, 20, 2)])
    expected = replay({f"k{i}": ("base", 0) for i in range(0, 20, 2)}, log)
    rng = random.Random(4)
    shuffled = rng.sample(log, len(log)) + log[:50]  # late, out of order, repeated
    assert state_of(apply_changes(base, events(spark, *shuffled))) == expected
    assert state_of(apply_changes(base, events(spark, *shuffled), few=True)) == expected


def test_folding_folds_changes_nothing(spark, log):
    whole = fold_changes(events(spark, *log))
    halves = fold_changes(events(spark, *log[::2])).unionByName(fold_changes(events(spark, *log[1::2])))
    assert sorted(map(str, merge_folds(halves).collect())) == sorted(map(str, whole.collect()))


def test_rename_and_lookup(spark, keyspace):
    target = keyspace(("old", "1", 50), ("x", "2"))
    source = keyspace(("new", "later"), ("y", "now"), ("z", "found"))
    log = events(
        spark,
        (1, 1, "rename", "old", None, None, "new"),
        (1, 2, "rename", "unknown", None, None, "z"),
        (2, 2, "set", "y", None, 30, None),
        (3, 3, "set", "lost", None, None, None),
        (4, 4, "expire", "x", None, 9, None),
        (5, 5, "expire", "absent", None, 9, None),
    )
    expected = {"new": ("1", 50), "z": ("found", 0), "y": ("now", 30), "x": ("2", 9)}
    assert state_of(apply_changes(target, log, source)) == expected
    few = apply_changes(target, log, source, few=True)
    assert state_of(few) == expected
    assert "LeftAnti, BuildRight" in plan_of(few)  # the untouched rows are not shuffled


@pytest.fixture
def renames():
    """Renames among other events: chains over many keys, sets before and after, hours apart. Old keys exist."""
    rng = random.Random(8)
    state, rows = {f"k{i}" for i in range(0, 20, 2)}, []
    for i in range(600):
        op, key, new = rng.choice(["set", "expire", "rename", "rename", "del"]), f"k{rng.randrange(20)}", None
        if op == "rename":
            key, new = rng.choice(sorted(state) or ["k0"]), f"k{rng.randrange(20)}"
        if op == "rename" and key not in state:
            continue
        if op in ("del", "rename"):
            state.discard(key)
        if op in ("set", "rename"):
            state.add(new or key)
        rows.append((i * 97, i, op, key, f"v{i}" if op == "set" else None, i + 1 if op in ("set", "expire") else None, new))
    return rows


def test_renames_equal_replay_without_a_source(spark, keyspace, renames):
    names = [f"k{i}" for i in range(0, 20, 2)]
    base = keyspace(*[(k, f"base {k}") for k in names])
    expected = replay({k: (f"base {k}", 0) for k in names}, renames)
    shuffled = random.Random(9).sample(renames, len(renames)) + renames[:70]
    assert state_of(apply_changes(base, events(spark, *shuffled))) == expected
    assert state_of(apply_changes(base, events(spark, *shuffled), few=True)) == expected


def some_renames(seed, keys, n, renames):
    """Events over few keys; old keys of renames are often absent."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = "rename" if rng.random() < renames else rng.choice(["set", "expire", "del", "del"])
        key, new = f"k{rng.randrange(keys)}", f"k{rng.randrange(keys)}" if op == "rename" else None
        ttl = i + 1 if op in ("set", "expire") else None
        rows.append((i * 61, i, op, key, f"v{i}" if op == "set" else None, ttl, new))
    return rows


@pytest.mark.parametrize("seed, keys, n, share", [(1, 6, 300, 0.5), (2, 40, 400, 0.9), (3, 12, 300, 1.0), (4, 200, 500, 0.8)])
def test_renames_of_absent_keys_equal_replay(spark, keyspace, seed, keys, n, share):
    names = [f"k{i}" for i in range(0, keys, 3)]
    rows = some_renames(seed, keys, n, share)
    base = keyspace(*[(k, f"base {k}", 77) for k in names])
    expected = replay({k: (f"base {k}", 77) for k in names}, rows)
    shuffled = random.Random(seed).sample(rows, n) + rows[: n // 5]
    assert state_of(apply_changes(base, events(spark, *shuffled))) == expected
    if seed == 2:
        assert state_of(apply_changes(base, events(spark, *shuffled), few=True)) == expected


def test_crowded_keys_are_put_in_order_by_chunks(spark, keyspace, monkeypatch):
    monkeypatch.setattr(renames_module, "CHUNK", 7)
    rows = some_renames(5, 5, 250, 0.6)
    # some at one moment
    rows = [(second // 9 * 9, *rest) for second, *rest in rows]
    base = keyspace(("k0", "base k0", 77), ("k3", "base k3", 77))
    expected = replay({"k0": ("base k0", 77), "k3": ("base k3", 77)}, rows)
    assert state_of(apply_changes(base, events(spark, *rows))) == expected


def test_rename_of_an_absent_key_undoes_nothing(spark, keyspace):
    base = keyspace(("t", "old", 5))
    rows = [
        (1, 1, "set", "b", "1", 9, None),
        (2, 2, "rename", "gone", None, None, "b"),
        (3, 3, "set", "t", "new", None, None),
        (4, 4, "rename", "gone", None, None, "t"),
        (5, 5, "del", "b", None, None, None),
        (6, 6, "rename", "gone", None, None, "b"),
        (7, 7, "rename", "b", None, None, "c"),
        (8, 8, "expire", "t", None, 30, None),
        (9, 9, "rename", "c", None, None, "t"),
    ]
    assert state_of(apply_changes(base, events(spark, *rows[:4]))) == {"b": ("1", 9), "t": ("new", 0)}
    assert state_of(apply_changes(base, events(spark, *rows))) == {"t": ("new", 30)}
    # a deleted key of the target does not come back by a rename of an absent one
    again = [(1, 1, "del", "t", None, None, None), (2, 2, "rename", "gone", None, None, "t")]
    assert state_of(apply_changes(base, events(spark, *again))) == {}
    # unless the source has it now
    assert state_of(apply_changes(base, events(spark, *again), keyspace(("t", "here")))) == {"t": ("here", 0)}


def test_renames_without_keys_are_nothing(spark, keyspace):
    rows = [(1, 1, "rename", "a", None, None, None), (2, 2, "rename", None, None, None, "a"), (3, 3, "rename", "a", None, None, "a")]
    assert state_of(apply_changes(keyspace(("a", "1")), events(spark, *rows))) == {"a": ("1", 0)}


def test_long_chain_keeps_value_type_and_ttl(spark, keyspace):
    base = keyspace(("c0", "v", 40))
    chain = [(i, i, "rename", f"c{i}", None, None, f"c{i + 1}") for i in range(33)]
    after = [(5, 100, "set", "c0", "again", 7, None), (40, 101, "rename", "c33", None, None, "c33")]
    assert state_of(apply_changes(base, events(spark, *chain, *after))) == {"c33": ("v", 40), "c0": ("again", 7)}
    set_then_moved = [(1, 1, "set", "c", "new", None, None), (2, 2, "rename", "c", None, None, "e")]
    assert state_of(apply_changes(base, events(spark, *set_then_moved)))["e"] == ("new", 0)


def test_late_rename_in_a_stream(spark, keyspace):
    folder = scratch_path(spark, "late")
    events(spark, (1, 1, "set", "a", "v1", None, None)).write.mode("append").parquet(f"{folder}/in")
    events(spark, (3, 3, "set", "a", "v2", None, None)).write.mode("append").parquet(f"{folder}/in")
    events(spark, (2, 2, "rename", "a", None, None, "b")).write.mode("append").parquet(f"{folder}/in")
    feed = change_feed(spark, f"{folder}/in", files_per_trigger=1)
    sync.stream_apply_changes(feed, f"{folder}/out", f"{folder}/check", {"availableNow": True}).awaitTermination()
    assert state_of(sync.changed_target(spark, keyspace(("k", "1")), f"{folder}/out")) == {
        "a": ("v2", 0), "b": ("v1", 0), "k": ("1", 0)
    }


def test_stream_reaches_the_batch_state(spark, keyspace, log):
    folder = scratch_path(spark, "feed")
    rng = random.Random(5)
    shuffled = rng.sample(log, len(log))
    for start in range(0, len(shuffled), 100):
        events(spark, *shuffled[start : start + 100]).write.mode("append").parquet(f"{folder}/in")
    base = keyspace(("k0", "base"), ("k19", "base"))
    for trigger in ({"availableNow": True},) * 2:  # the second start finds nothing new
        feed = change_feed(spark, f"{folder}/in", files_per_trigger=1)
        sync.stream_apply_changes(feed, f"{folder}/out", f"{folder}/check", trigger).awaitTermination()
    streamed = sync.changed_target(spark, base, f"{folder}/out")
    assert state_of(streamed) == state_of(apply_changes(base, events(spark, *log)))

