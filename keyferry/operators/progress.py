"""Counters, progress, speed, worker totals, metric series and prefix profiles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.functions.text import human_bytes, human_duration
from keyferry.functions.values import octets
from keyferry.operators.filters import KeyFilter, filter_keys, filter_verdict
from keyferry.operators.merge import plan_merge

OUTCOMES = ("migrated", "skipped", "filtered", "failed")


def migration_summary(plan: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """One row of counters for a merge plan and, optionally, the keys the filter dropped."""
    outcomes = plan.select("outcome", "bytes_moved")
    if filtered is not None:
        outcomes = outcomes.unionByName(
            filtered.select(F.lit("filtered").alias("outcome"), F.lit(0).cast("long").alias("bytes_moved"))
        )
    return outcomes.agg(
        F.count("*").alias("keys_total"),
        *[F.count_if(F.col("outcome") == o).alias(f"keys_{o}") for o in OUTCOMES],
        F.coalesce(F.sum("bytes_moved"), F.lit(0)).alias("bytes_migrated"),
    )


def full_load_summary(
    source: DataFrame, target: DataFrame, rule: KeyFilter = KeyFilter(), policy: str = "skip_full_only"
) -> DataFrame:
    """Counters of a full load: filter, plan, count. Dropped keys are counted where they are scanned."""
    dropped = None
    if rule != KeyFilter():
        dropped = filter_verdict(source.select("key", "type"), rule).filter(~F.col("kept"))
    return migration_summary(plan_merge(filter_keys(source, rule), target, policy), dropped)


def progress(counters: DataFrame, basis: str = "handled") -> DataFrame:
    """Add ``percentage`` to rows of counters.

    ``handled`` counts migrated, skipped and filtered keys and stops at 100; ``migrated`` counts only
    migrated keys and may pass 100. Failed keys never count.
    """
    total = F.col("keys_total")
    if basis == "handled":
        part = (F.col("keys_migrated") + F.col("keys_skipped") + F.col("keys_filtered")).cast("double")
        share = F.least(part / total * 100, F.lit(100.0))
    elif basis == "migrated":
        share = F.col("keys_migrated").cast("double") / total * 100
    else:
        raise ValueError(f"basis must be 'handled' or 'migrated', not {basis!r}")
    return counters.withColumn("percentage", F.when(total > 0, share).otherwise(F.lit(0.0)))


def throughput_eta(counters: DataFrame, now: Column | int) -> DataFrame:
    """Add whole keys per second and the seconds left for rows with ``started_at`` (unix seconds).

    No estimate without speed or when nothing remains.
    """
    now = F.lit(now) if isinstance(now, int) else now
    elapsed = now - F.col("started_at")
    speed = F.when(elapsed > 0, F.floor(F.col("keys_migrated") / elapsed)).otherwise(0).cast("long")
    left = F.col("keys_total") - F.col("keys_migrated")
    eta = F.when((F.col("speed") > 0) & (left > 0), F.floor(left / F.col("speed")).cast("long"))
    return (
        counters.withColumn("speed", speed)
        .withColumn("eta_s", eta)
        .withColumn("eta_text", human_duration(F.col("eta_s")))
        .withColumn("elapsed_text", human_duration(elapsed))
    )


def worker_totals(reports: DataFrame) -> DataFrame:
    """Reported keys, bytes and errors per worker, and per run where ``worker_id`` is null."""
    by_worker = reports.groupBy("task_id", "worker_id").agg(
        F.sum("keys_processed").alias("keys"),
        F.sum("bytes_sent").alias("bytes"),
        F.sum("error_count").alias("errors"),
        F.max("ts").alias("last_active"),
    )
    # the rollup works on one row per worker, not on the reports
    return (
        by_worker.rollup("task_id", "worker_id")
        .agg(
            F.sum("keys").alias("keys"),
            F.sum("bytes").alias("bytes"),
            F.sum("errors").alias("errors"),
            F.max("last_active").alias("last_active"),
        )
        .filter(F.col("task_id").isNotNull())
    )


def metric_series(points: DataFrame, start: int, end: int, task_id: str | None = None) -> DataFrame:
    """Points with ``start <= timestamp <= end``, by run and metric in time order.

    The series stay rows of a range-sorted table, so one long series is spread over many tasks.
    """
    chosen = points.filter(F.col("timestamp").between(start, end))
    if task_id is not None:
        chosen = chosen.filter(F.col("task_id") == task_id)
    return chosen.orderBy("task_id", "metric_name", "timestamp", "metric_value")


def prefix_profile(rows: DataFrame, delimiter: str = ":", percentiles: list[float] | None = None) -> DataFrame:
    """Keys, bytes and average size per key prefix; approximate size percentiles on request."""
    size = octets(F.col("value"))
    extra = [F.percentile_approx(size, percentiles).alias("size_percentiles")] if percentiles else []
    profile = rows.groupBy(F.substring_index("key", delimiter, 1).alias("prefix")).agg(
        F.count("*").alias("keys"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        *extra,
    )
    return profile.withColumn("avg_bytes", F.col("bytes").cast("double") / F.col("keys")).withColumn(
        "bytes_text", human_bytes(F.col("bytes"))
    )
