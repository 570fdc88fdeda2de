"""When the incremental loop of a run has converged."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry.functions.ranking import with_position


@dataclass(frozen=True)
class ConvergenceRule:
    """Fixed default thresholds; the first condition that holds gives the reason."""

    change_count: int = 1000
    change_rate: float = 0.001
    history: int = 10
    window_minutes: int = 10
    window_changes: int = 5000
    window_records: int = 3
    max_iterations: int = 10


def convergence(records: DataFrame, rule: ConvergenceRule = ConvergenceRule(), chunk: int = 4096) -> DataFrame:
    """Per iteration of every run whether it has converged, and why.

    A record sees itself and the records before it, up to ``history`` in all. Long runs are cut into
    chunks by position; each chunk also gets the few records before it, so no run needs one task.
    """
    lead = rule.history - 1
    placed = with_position(records, "task_id", "iteration", chunk).withColumn(
        "_own", F.floor(F.col("position") / chunk)
    )
    overlapped = placed.withColumn(
        "_chunk", F.explode(F.sequence("_own", F.floor((F.col("position") + lead) / chunk)))
    )
    in_order = W.partitionBy("task_id", "_chunk").orderBy("position")
    recent = F.collect_list(F.struct("ts", "change_count")).over(in_order.rowsBetween(-lead, 0))
    count, total = F.col("change_count"), F.col("total_keys")
    cutoff = F.col("ts") - F.make_interval(mins=F.lit(rule.window_minutes))
    windowed = F.aggregate(
        F.filter("_recent", lambda r: r["ts"] > F.col("_cutoff")),
        F.lit(0).cast("long"),
        lambda total_, r: total_ + r["change_count"],
    )
    size = F.size("_recent")
    reason = (
        F.when(count < rule.change_count, "change_count_below_threshold")
        .when((total > 0) & (count.cast("double") / total < rule.change_rate), "change_rate_below_threshold")
        .when((size >= rule.window_records) & (windowed < rule.window_changes), "window_changes_stable")
        .when(size >= rule.max_iterations, "max_iterations_reached")
    )
    return (
        overlapped.withColumn("_recent", recent)
        .filter(F.col("_chunk") == F.col("_own"))
        .withColumn("_cutoff", cutoff)
        .withColumn("reason", reason)
        .withColumn("converged", F.col("reason").isNotNull())
        .select("task_id", "iteration", "change_count", "total_keys", "ts", "converged", "reason")
    )


def stopping_iteration(judged: DataFrame) -> DataFrame:
    """The first converged iteration of every run; null when there is none."""
    first = F.min(F.when(F.col("converged"), F.struct("iteration", "reason")))
    return (
        judged.groupBy("task_id")
        .agg(first.alias("stop"))
        .select("task_id", F.col("stop.iteration").alias("iteration"), F.col("stop.reason").alias("reason"))
    )
