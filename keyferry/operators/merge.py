"""Conflict policies, the merged target, and incremental batches.

Source and target hold one row per key, as ``scan_keyspace`` gives them.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.functions.values import normal_ttl, octets
from keyferry.operators.filters import KeyFilter, filter_keys, filter_verdict

POLICIES = ("skip", "replace", "error", "skip_full_only")
PHASES = ("full", "incremental")
EXISTS_DETAIL = "Key already exists in target"
CONFLICT_DETAIL = "key conflict"
VANISHED_DETAIL = "vanished"


def effective_policy(policy: str, phase: str = "full") -> str:
    """The policy that holds in a phase; an unknown name counts as ``skip_full_only``."""
    if phase not in PHASES:
        raise ValueError(f"phase must be one of {PHASES}, not {phase!r}")
    if policy not in POLICIES:
        policy = "skip_full_only"
    if policy == "skip_full_only":
        return "skip" if phase == "full" else "replace"
    return policy


def batch_exists(keys: DataFrame, target: DataFrame) -> DataFrame:
    """Every key with a flag whether the target has it. Only keys are shuffled."""
    present = target.select("key").distinct().withColumn("_present", F.lit(True))
    return keys.join(present, "key", "left").withColumn("exists", F.col("_present").isNotNull()).drop("_present")


def plan_merge(
    source: DataFrame, target: DataFrame, policy: str = "skip_full_only", phase: str = "full", strict: bool = False
) -> DataFrame:
    """What happens to each source key: ``migrated``, ``skipped`` or ``failed``, and the bytes it moves.

    A key without value has vanished since the scan and is skipped. ``replace`` needs no look at the
    target. Sizes are taken before the join, so values are never shuffled. With ``strict`` a conflict
    under ``error`` makes the job fail.
    """
    policy = effective_policy(policy, phase)
    sized = source.select("key", "type", octets(F.col("value")).alias("_bytes"))
    if policy == "replace":
        checked = sized.withColumn("exists", F.lit(False))
    else:
        checked = batch_exists(sized, target)
    gone = F.col("_bytes").isNull()
    blocked = F.col("exists") & ~gone
    conflict = F.raise_error(F.concat(F.lit("key already exists: "), F.col("key"))) if strict else F.lit("failed")
    outcome = (
        F.when(gone, F.lit("skipped"))
        .when(blocked, conflict if policy == "error" else F.lit("skipped"))
        .otherwise(F.lit("migrated"))
    )
    detail = F.when(gone, VANISHED_DETAIL).when(blocked, CONFLICT_DETAIL if policy == "error" else EXISTS_DETAIL)
    return checked.select(
        "key",
        "type",
        outcome.alias("outcome"),
        detail.alias("detail"),
        F.when(gone | blocked, 0).otherwise(F.col("_bytes")).cast("long").alias("bytes_moved"),
    )


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among ``keys``.

    The keys of a partition are hashed, a few dozen bytes for each, and the rows pass by: rows with values are not sorted.
    """
    return rows.join(keys.select("key").hint("shuffle_hash"), "key", "left_anti").select(rows.columns)


def merge_result(source: DataFrame, target: DataFrame, policy: str = "skip_full_only", phase: str = "full") -> DataFrame:
    """The target after the merge, with moved keys carrying a TTL of at least 0.

    One side always wins whole, so the merge is the winning side plus the other side without the
    winner's keys: the winner's values stay where they are and only its keys are shuffled.
    """
    columns = schemas.KEYSPACE.names
    moved = source.filter(F.col("value").isNotNull()).withColumn("ttl_s", normal_ttl(F.col("ttl_s"))).select(*columns)
    kept = target.select(*columns)
    if effective_policy(policy, phase) == "replace":
        return moved.unionByName(_without(kept, moved))
    return kept.unionByName(_without(moved, kept))


def conflict_log(plan: DataFrame) -> DataFrame:
    """Source keys left out because the target already had them."""
    return plan.filter((F.col("outcome") == "skipped") & (F.col("detail") == EXISTS_DETAIL)).select("key", "type")


def new_keys(current: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the current scan whose key is not in the known snapshot."""
    return _without(current, known)


def snapshot_diff(current: DataFrame, known: DataFrame) -> DataFrame:
    """Every key of either snapshot as ``new``, ``common`` or ``gone``, from one grouped pass."""
    both = (
        current.select("key", F.lit(1).alias("now"), F.lit(0).alias("then"))
        .unionByName(known.select("key", F.lit(0).alias("now"), F.lit(1).alias("then")))
        .groupBy("key")
        .agg(F.max("now").alias("now"), F.max("then").alias("then"))
    )
    status = F.when(F.col("then") == 0, "new").when(F.col("now") == 0, "gone").otherwise("common")
    return both.select("key", status.alias("status"))


class IncrementalBatch(NamedTuple):
    plan: DataFrame
    known: DataFrame
    target: DataFrame


def incremental_batch(
    current: DataFrame, known: DataFrame, target: DataFrame, rule: KeyFilter = KeyFilter(), policy: str = "replace"
) -> IncrementalBatch:
    """One round of incremental sync: keys not known before are filtered and merged.

    Returns the outcome of each new key (``filtered`` included), the known keys afterwards, with
    filtered and failed ones among them, and the merged target.
    """
    fresh = new_keys(current, known)
    kept = filter_keys(fresh, rule)
    dropped = filter_verdict(fresh.select("key", "type"), rule).filter(~F.col("kept"))
    plan = plan_merge(kept, target, policy, "incremental").unionByName(
        dropped.select(
            "key",
            "type",
            F.lit("filtered").alias("outcome"),
            F.col("rule").alias("detail"),
            F.lit(0).cast("long").alias("bytes_moved"),
        )
    )
    return IncrementalBatch(
        plan=plan,
        known=known.select("key").unionByName(current.select("key")).distinct(),
        target=merge_result(kept, target, policy, "incremental"),
    )
