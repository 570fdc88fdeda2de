"""Slot columns, slot histograms, slot ranges and their workload."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry.functions.slots import SLOT_COUNT, slot
from keyferry.functions.values import octets


def with_slot(rows: DataFrame, strict_tag: bool = False) -> DataFrame:
    return rows.withColumn("slot", slot(F.col("key"), strict_tag))


def _slotted(rows: DataFrame) -> DataFrame:
    return rows if "slot" in rows.columns else with_slot(rows)


def slot_histogram(rows: DataFrame) -> DataFrame:
    """Keys and bytes per slot. At most 16384 rows, summed map-side first."""
    return (
        _slotted(rows)
        .groupBy("slot")
        .agg(F.count("*").alias("keys"), F.coalesce(F.sum(octets(F.col("value"))), F.lit(0)).alias("bytes"))
    )


def slot_skew(rows: DataFrame) -> DataFrame:
    """Used slots, largest and average slot, and their ratio over all slots that hold keys."""
    return slot_histogram(rows).agg(
        F.count("*").alias("used_slots"),
        F.max("keys").alias("max_keys"),
        F.sum("keys").alias("total_keys"),
        (F.max("keys") * F.count("*") / F.sum("keys")).alias("skew"),
    )


def slot_ranges(plan: DataFrame) -> DataFrame:
    """Contiguous slot ranges for rows (task_id, workers): equal width, the last takes the remainder."""
    workers = F.col("workers")
    checked = F.when(workers.between(1, SLOT_COUNT), workers).otherwise(
        F.raise_error(F.lit(f"workers must lie in 1..{SLOT_COUNT}"))
    )
    width = F.floor(F.lit(SLOT_COUNT) / workers).cast("int")
    index = F.col("index")
    return (
        plan.withColumn("workers", checked.cast("int"))
        .withColumn("index", F.explode(F.sequence(F.lit(0), workers - 1)))
        .select(
            "task_id",
            F.concat(F.lit("worker-"), index.cast("string")).alias("worker_id"),
            (index * width).cast("int").alias("slot_start"),
            F.when(index == workers - 1, F.lit(SLOT_COUNT - 1))
            .otherwise((index + 1) * width - 1)
            .cast("int")
            .alias("slot_end"),
        )
    )


def range_workload(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keys and bytes in each worker's slot range; a worker without keys shows 0.

    Keys are summed per slot, then along the slots. The workload of a range is the difference of two of
    those running totals, so the range join becomes two lookups in a table of 16385 rows, however many
    ranges there are and however they overlap.
    """
    every_slot = rows.sparkSession.range(-1, SLOT_COUNT).select(F.col("id").cast("int").alias("slot"))
    upto = W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    totals = F.broadcast(
        every_slot.join(slot_histogram(rows), "slot", "left").select(
            "slot", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("keys", "bytes")]
        )
    )
    before = totals.select(*[F.col(c).alias(f"_before_{c}") for c in totals.columns])
    through = totals.select(*[F.col(c).alias(f"_through_{c}") for c in totals.columns])
    last = F.least(F.col("slot_end"), F.lit(SLOT_COUNT - 1))
    previous = F.greatest(F.col("slot_start") - 1, F.lit(-1))

    def within(measure: str) -> Column:
        inside = F.col(f"_through_{measure}") - F.col(f"_before_{measure}")
        return F.coalesce(F.when(F.col("slot_start") <= F.col("slot_end"), inside), F.lit(0)).alias(measure)

    return (
        ranges.join(before, F.col("_before_slot") == previous, "left")
        .join(through, F.col("_through_slot") == last, "left")
        .select("task_id", "worker_id", "slot_start", "slot_end", within("keys"), within("bytes"))
    )
