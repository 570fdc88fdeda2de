"""Comparing a source with its target: samples, full checks and their history."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.functions.ranking import top_rows
from keyferry.functions.values import canonical_value, digest, normal_ttl
from keyferry.operators.digests import compare_digests, digest_rows
from keyferry.session import stored

DEFAULT_SAMPLE = 10_000


def canonical_values(typed: DataFrame) -> DataFrame:
    """Typed containers as keyspace rows with one comparable value each."""
    value = canonical_value(*[F.col(c) for c in ("type", "str", "hash", "list", "set", "zset")])
    return typed.select("key", "type", value.alias("value"))


def _digests(rows: DataFrame, with_ttl: bool, *extra: str) -> DataFrame:
    """Key, type and digest: what is compared, so values are never shuffled."""
    ttl = [normal_ttl(F.col("ttl_s")).alias("ttl_s")] if with_ttl else []
    return rows.select("key", "type", digest(F.col("value")).alias("digest"), *ttl, *extra)


def sample_keys(source: DataFrame, n: int = DEFAULT_SAMPLE) -> DataFrame:
    """The ``n`` source rows whose keys come first in digest order: random-like, yet repeatable."""
    order = F.md5("key")
    chosen = top_rows(source.select("key"), [order, F.col("key")], n, bucket=F.substring(order, 1, 4))
    return source.join(chosen, "key", "left_semi")


def _status(present: Column, same: Column) -> Column:
    return F.when(~present, "missing").when(same, "matched").otherwise("mismatched")


def verify_rows(
    source: DataFrame, target: DataFrame, compare_ttl: bool = False, sample_size: int | None = None, keep: tuple = ()
) -> DataFrame:
    """Each source key as ``matched``, ``mismatched`` or ``missing`` in the target.

    When ``source`` is a sample, pass its size: its digests are then taken once and stored, and Spark, which knows the
    bytes of what is stored, sends few of them to the target scan, so that the target is read once and not shuffled.
    ``keep`` names source columns to carry along.
    """
    left = _digests(source, compare_ttl, *keep)
    right = _digests(target, compare_ttl)
    if sample_size is not None:
        left = stored(left, "sample")
        right = right.join(left.select("key"), "key", "left_semi")
    right = right.select(*[F.col(c).alias(c if c == "key" else f"_{c}") for c in right.columns])
    joined = left.join(right, "key", "left")
    compared = ["type", "digest"] + (["ttl_s"] if compare_ttl else [])
    same = F.struct(*compared).eqNullSafe(F.struct(*[F.col(f"_{c}").alias(c) for c in compared]))
    return joined.select("key", "type", *keep, _status(F.col("_type").isNotNull(), same).alias("status"))


def _counts() -> list[Column]:
    return [
        F.count("*").alias("total_keys"),
        F.count_if(F.col("status") == "matched").alias("matched_keys"),
        F.count_if(F.col("status") == "mismatched").alias("mismatched_keys"),
        F.count_if(F.col("status") == "missing").alias("missing_keys"),
    ]


def _rate() -> Column:
    matched, total = F.col("matched_keys").cast("double"), F.col("total_keys")
    return F.when(total > 0, matched / total * 100).otherwise(F.lit(0.0))


def verify_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*_counts()).withColumn("consistency_rate", _rate())


def verify_by_group(rows: DataFrame, group: Column | str) -> DataFrame:
    """The summary per type, key prefix, slot bucket or any other expression over the compared rows."""
    group = F.col(group) if isinstance(group, str) else group
    return rows.groupBy(group.alias("group")).agg(*_counts()).withColumn("consistency_rate", _rate())


def verify_full(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every key of either side: ``matched``, ``mismatched``, ``missing`` or ``extra``."""
    return _compare_all(_digests(source, False), _digests(target, False))


def _compare_all(source: DataFrame, target: DataFrame) -> DataFrame:
    """``verify_full`` over digests that have been taken."""
    left = source.select("key", F.col("type").alias("_st"), F.col("digest").alias("_sd"))
    right = target.select("key", F.col("type").alias("_tt"), F.col("digest").alias("_td"))
    source_side = F.struct(F.col("_st").alias("type"), F.col("_sd").alias("digest"))
    target_side = F.struct(F.col("_tt").alias("type"), F.col("_td").alias("digest"))
    status = F.when(F.col("_st").isNull(), "extra").otherwise(
        _status(F.col("_tt").isNotNull(), source_side.eqNullSafe(target_side))
    )
    return left.join(right, "key", "full_outer").select(
        "key", F.coalesce("_st", "_tt").alias("type"), status.alias("status")
    )


def verify_full_summary(rows: DataFrame) -> DataFrame:
    """Counts of a full check. Extra keys are counted apart and do not lower the rate."""
    own = F.col("status") != "extra"
    return rows.agg(
        F.count_if(own).alias("total_keys"),
        *_counts()[1:],
        F.count_if(~own).alias("extra_keys"),
    ).withColumn("consistency_rate", _rate())


def verify_two_level(source: DataFrame, target: DataFrame, group: Column, n: int = DEFAULT_SAMPLE) -> DataFrame:
    """Sample first; then check in full every group in which the sample found a fault.

    ``group`` is an expression over ``key`` or ``type``, so that both sides fall into the same groups.
    Rows: per group the sample summary (level 1) and, where it failed, the full summary (level 2).

    The full check compares digest tables of the failing groups, which are at most as many as the sample's rows, by their
    slots: keys meet only where digest sums differ, and a group's rows never meet at all.
    """
    sampled = stored(verify_by_group(verify_rows(sample_keys(source, n), target, sample_size=n), group), "sampled-groups")
    first = sampled.withColumn("extra_keys", F.lit(0).cast("long")).withColumn("level", F.lit(1))
    failing = sampled.filter(F.col("matched_keys") < F.col("total_keys")).select(F.col("group").alias("_group"))
    if failing.isEmpty():
        return first

    def suspects(side: DataFrame) -> DataFrame:
        of_groups = side.join(failing, group.eqNullSafe(F.col("_group")), "left_semi")
        return stored(digest_rows(of_groups, hashed=True), "digests")

    own = F.col("status") != "extra"
    checked = (
        compare_digests(suspects(source), suspects(target))
        .groupBy(group.alias("group"))
        .agg(F.count_if(own).alias("total_keys"), *_counts()[1:], F.count_if(~own).alias("extra_keys"))
        .withColumn("consistency_rate", _rate())
        .withColumn("level", F.lit(2))
    )
    return first.unionByName(checked)


def verify_history(batches: DataFrame) -> DataFrame:
    """Verify batches of every run, newest first, with their rate."""
    return batches.withColumn("consistency_rate", _rate()).orderBy("task_id", F.desc("created_at"), F.desc("id"))
