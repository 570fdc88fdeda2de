"""Searching, counting and trimming log tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry.functions.ranking import top_rows

# Fixed values of the log tables.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LOGS_KEPT = 10_000
# Width of the id ranges counted to find the newest rows.
ID_BLOCK = 4096


@dataclass(frozen=True)
class LogFilter:
    """Conditions on log rows; an empty one does not count. Times are inclusive texts."""

    level: str = ""
    request_id: str = ""
    task_id: str = ""
    task_prefix: str = ""
    keyword: str = ""
    start_time: str = ""
    end_time: str = ""


def filter_logs(logs: DataFrame, wanted: LogFilter) -> DataFrame:
    if wanted.level:
        logs = logs.filter(F.col("level") == wanted.level.upper())
    if wanted.request_id:
        logs = logs.filter(F.col("request_id") == wanted.request_id)
    if wanted.task_id:
        logs = logs.filter(F.col("task_id") == wanted.task_id)
    if wanted.task_prefix:
        logs = logs.filter(F.col("task_id").startswith(wanted.task_prefix))
    if wanted.keyword:
        logs = logs.filter(F.lower("message").contains(wanted.keyword.lower()))
    if wanted.start_time:
        logs = logs.filter(F.col("timestamp") >= wanted.start_time)
    if wanted.end_time:
        logs = logs.filter(F.col("timestamp") <= wanted.end_time)
    return logs


# Newest first; rows without an id come last.
NEWEST = ("id", "timestamp", "message")


def newest_logs(logs: DataFrame, n: int) -> DataFrame:
    order = [F.desc(c) for c in NEWEST]
    return top_rows(logs, order, n, bucket=F.floor(F.col("id") / ID_BLOCK), bucket_desc=True)


def retain_logs(logs: DataFrame, keep: int | None = None) -> DataFrame:
    """The newest ``keep`` log rows; all without a number. ``LOGS_KEPT`` is the usual one."""
    return logs if keep is None else newest_logs(logs, keep)


def search_logs(logs: DataFrame, wanted: LogFilter = LogFilter(), offset: int = 0, limit: int = 0) -> DataFrame:
    """Matching log rows, newest first, each with the ``total`` of matches; ``limit`` 0 returns all.

    Without a limit the rows before the offset are skipped by id, so the rest stays distributed. Only rows with the last
    skipped id, and rows without an id, which come last, are numbered to be skipped.
    """
    found = filter_logs(logs, wanted)
    newest = [F.desc(c) for c in NEWEST]
    total = found.agg(F.count("*").alias("total")).scalar()
    page = found
    if limit:
        page = newest_logs(found, offset + limit).orderBy(*newest).offset(offset)
    elif offset:
        skipped = newest_logs(found, offset).filter(F.col("id").isNotNull())
        of_id = skipped.groupBy("id").agg(F.count("*").alias("rows"))
        last = of_id.agg(F.min(F.struct("id", "rows")).alias("last")).scalar()
        with_id = found.agg(F.count("id").alias("rows")).scalar()
        number = F.row_number().over(W.orderBy(*newest))
        bare = found.filter(F.col("id").isNull()).withColumn("_number", number)
        tied = found.filter(F.col("id") == last["id"]).withColumn("_number", number)
        page = (
            found.filter(F.col("id") < last["id"])
            .unionByName(tied.filter(F.col("_number") > last["rows"]).drop("_number"))
            .unionByName(bare.filter(F.col("_number") + with_id > offset).drop("_number"))
        )
    return page.orderBy(*newest).withColumn("total", total)


def log_level_stats(logs: DataFrame) -> DataFrame:
    """Rows per level, all five levels present, plus the total."""
    known = logs.agg(
        F.count("*").alias("TOTAL"), *[F.count_if(F.col("level") == level).alias(level) for level in LEVELS]
    )
    return known.unpivot([], ["TOTAL", *LEVELS], "level", "entries")


def clear_run_logs(logs: DataFrame, task_ids: DataFrame) -> DataFrame:
    """Logs without those of the given runs; rows of no run stay."""
    return logs.join(task_ids.select("task_id"), "task_id", "left_anti")
