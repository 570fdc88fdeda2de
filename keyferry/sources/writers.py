"""Sinks: snapshots, metric points, error-key CSV, log exports and run reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyferry import schemas
from keyferry.functions.slots import slot, slot_bucket
from keyferry.sources.logs import EXPORT_TITLE, RULE, log_line

# Columns of the error-key file.
ERROR_KEY_HEADER = {"key": "Key", "type": "Type", "reason": "Reason", "detail": "Detail", "timestamp": "Timestamp"}


def write_snapshot(keyspace: DataFrame, path: str, buckets: int = 64) -> None:
    """Write a keyspace to a new version folder, partitioned by slot bucket.

    The rebalance hint groups rows by bucket so each file belongs to one, and lets adaptive execution
    split a bucket that a hot slot has made too large. An existing folder is an error: the version being
    read must never be the one written.
    """
    stored = keyspace.withColumn("slot_bucket", slot_bucket(slot(F.col("key")), buckets))
    stored.hint("rebalance", "slot_bucket").write.mode("error").partitionBy("slot_bucket").parquet(path)


def write_snapshot_table(keyspace: DataFrame, table: str, path: str, buckets: int = 1024) -> None:
    """Write a keyspace as a new table bucketed and sorted by key.

    Merging or comparing two tables with the same number of buckets needs no shuffle. For keyspaces that
    are merged again and again; choose ``buckets`` so that one fits a task.
    """
    writer = keyspace.repartition(buckets, "key").write.mode("error").option("path", path)
    writer.bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(table)


def append_metrics(points: DataFrame, path: str) -> None:
    """Append metric points to a table partitioned by metric name."""
    points.hint("rebalance", "metric_name").write.mode("append").partitionBy("metric_name").parquet(path)


def export_error_keys_csv(errors: DataFrame, path: str) -> None:
    """Error keys as CSV: a header, every field quoted, quotes doubled."""
    shaped = errors.select(*[F.col(column).alias(title) for column, title in ERROR_KEY_HEADER.items()])
    shaped.write.mode("error").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_logs_json(logs: DataFrame, path: str) -> None:
    """Log rows newest first as JSON lines; absent fields are left out."""
    logs.orderBy(F.desc("id")).write.mode("error").json(path)


def log_export_lines(logs: DataFrame, exported_at: str, level: str = "", keyword: str = "", task: str = "") -> DataFrame:
    """Text of a log export: a title with count and filter, then the rows newest first.

    The title is one row derived from the same logs that sorts before all others; the sort is a range
    shuffle, so the text is written by many tasks and its files follow in name order.
    """
    title = logs.agg(F.count("*").alias("rows")).select(
        F.lit(0).alias("part"),
        F.lit(0).cast("long").alias("id"),
        F.concat_ws(
            "\n",
            F.lit(EXPORT_TITLE),
            F.lit(f"Export Time: {exported_at}"),
            F.concat(F.lit("Total Entries: "), F.col("rows").cast("string")),
            F.lit(f"Filter: level={level}, keyword={keyword}, task={task}"),
            F.lit(RULE),
            F.lit(""),
        ).alias("value"),
    )
    body = logs.select(F.lit(1).alias("part"), "id", log_line(stacks=True).alias("value"))
    return title.unionByName(body).orderBy("part", F.desc("id"))


def export_logs_text(logs: DataFrame, path: str, exported_at: str, **shown_filter: str) -> None:
    log_export_lines(logs, exported_at, **shown_filter).select("value").write.mode("error").text(path)


def run_report(runs: DataFrame, stats: DataFrame, verifications: DataFrame) -> DataFrame:
    """Report of every run as JSON parts in reading order: task, stats, then verify results newest first.

    Each part is a whole record (``schemas.RUN``, ``STATS``, ``VERIFY``), absent values as null. One row per part instead of
    one document per run, so a run with very many verify batches is spread over tasks. A run without stats gets a zero
    record without times.
    """
    zero = F.lit(0).cast("long")

    def document(record: StructType, *columns: Column | str) -> Column:
        return F.to_json(F.struct(*(columns or record.names)), {"ignoreNullFields": "false"}).alias("document")

    task = runs.select(F.col("id").alias("run_id"), F.lit(1).alias("section"), zero.alias("newest"), document(schemas.RUN))
    filled = runs.select(F.col("id").alias("task_id")).join(stats, "task_id", "left")
    times = ("task_id", "start_time", "end_time")
    counts = [c if c in times else F.coalesce(F.col(c), zero).alias(c) for c in schemas.STATS.names]
    totals = filled.select(
        F.col("task_id").alias("run_id"), F.lit(2).alias("section"), zero.alias("newest"), document(schemas.STATS, *counts)
    )
    batches = verifications.join(runs.select(F.col("id").alias("task_id")), "task_id", "left_semi").select(
        F.col("task_id").alias("run_id"), F.lit(3).alias("section"), F.col("created_at").alias("newest"), document(schemas.VERIFY)
    )
    parts = task.unionByName(totals).unionByName(batches)
    return parts.orderBy("run_id", "section", F.desc("newest"), "document").select("run_id", "section", "document")
