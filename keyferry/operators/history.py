"""Runs, checkpoints, attempts and error keys: latest state, retention, listing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry.functions.ranking import first_per_group

# Fixed values of the run history.
STATUSES = ("pending", "running", "paused", "completed", "failed")
ERROR_KEY_CAP = 10_000
ERROR_KEYS_SHOWN = 100
RUNS_KEPT = 3
MAX_RETRIES = 3
FULL_RETRY_MS = 100
INCREMENTAL_RETRY_MS = 1000
DEFAULT_PAGE_SIZE = 20
# Width of the sequence ranges counted to find the first rows of a run.
SEQ_BLOCK = 4096


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The last written row per (task, worker, slot). Ties are broken by every column."""
    key = ["task_id", "worker_id", "slot_id"]
    rest = [F.desc(c) for c in checkpoints.columns if c not in (*key, "updated_at", "seq")]
    last = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("updated_at"), F.desc("seq"), *rest))
    return checkpoints.withColumn("_rank", last).filter(F.col("_rank") == 1).drop("_rank")


def resume_slots(ranges: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Slots of the planned ranges with work left.

    A slot is finished when the latest row of some worker has cursor ``0`` and migrated keys.
    """
    finished = (
        latest_checkpoint(checkpoints)
        .filter((F.col("cursor") == "0") & (F.col("keys_migrated") > 0))
        .select("task_id", F.col("slot_id").alias("slot"))
        .distinct()
    )
    planned = ranges.select("task_id", "worker_id", F.explode(F.sequence("slot_start", "slot_end")).alias("slot"))
    return planned.join(finished, ["task_id", "slot"], "left_anti").select("task_id", "worker_id", "slot")


def resolve_attempts(attempts: DataFrame, phase: str = "full", max_retries: int = MAX_RETRIES) -> DataFrame:
    """One outcome per key from its attempts (task_id, key, attempt, outcome).

    The first ``ok`` or ``skipped`` within ``max_retries`` wins, otherwise the key has failed. Between
    attempts the wait grows by one interval; ``waited_ms`` is the sum. Attempt and outcome are folded as
    one number, so hash aggregation does it, map-side first, however many attempts a key has.
    """
    interval = FULL_RETRY_MS if phase == "full" else INCREMENTAL_RETRY_MS
    ends = F.col("outcome").isin("ok", "skipped") & (F.col("attempt") <= max_retries)
    ended = F.col("attempt").cast("long") * 2 + (F.col("outcome") == "skipped").cast("long")
    final = F.col("final")
    used = F.coalesce(F.floor(final / 2), F.least(F.col("tries"), F.lit(max_retries)))
    return (
        attempts.groupBy("task_id", "key")
        .agg(F.min(F.when(ends, ended)).alias("final"), F.max("attempt").alias("tries"))
        .select(
            "task_id",
            "key",
            F.when(final.isNull(), "failed").when(final % 2 == 0, "ok").otherwise("skipped").alias("outcome"),
            used.cast("int").alias("attempts"),
            F.when(final.isNull(), F.lit(f"(after {max_retries} retries)")).alias("detail"),
            (F.floor(used * (used - 1) / 2) * interval).cast("long").alias("waited_ms"),
        )
    )


def dead_letters(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("outcome") == "failed")


def cap_error_keys(errors: DataFrame, cap: int | None = None) -> DataFrame:
    """The first ``cap`` error rows of every run, in order of ``seq`` and key; all without a number.

    ``ERROR_KEY_CAP`` is the usual one. Rows without a ``seq`` come first.
    """
    if cap is None:
        return errors
    return first_per_group(errors, "task_id", ["seq", "key"], cap, bucket=F.floor(F.col("seq") / SEQ_BLOCK))


def shown_error_keys(errors: DataFrame, shown: int = ERROR_KEYS_SHOWN) -> DataFrame:
    return cap_error_keys(errors, shown)


def error_key_stats(errors: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Error rows per run: all, failed, skipped, and large keys from rows (task_id, key) of ``large``."""
    stats = errors.groupBy("task_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reason") == "failed").alias("failed"),
        F.count_if(F.col("reason") == "skipped").alias("skipped"),
    )
    if large is None:
        return stats.withColumn("large_keys", F.lit(0).cast("long"))
    counts = large.groupBy("task_id").agg(F.count("*").alias("large_keys"))
    return stats.join(counts, "task_id", "left").withColumn("large_keys", F.coalesce("large_keys", F.lit(0)))


def retain_runs(runs: DataFrame, keep: int = RUNS_KEPT) -> DataFrame:
    """The ``keep`` newest runs and every running one."""
    newest = runs.select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(keep)
    marked = newest.select("id", F.lit(True).alias("_newest"))
    kept = runs.join(marked, "id", "left").filter(F.col("_newest").isNotNull() | (F.col("status") == "running"))
    return kept.drop("_newest")


def dropped_runs(runs: DataFrame, keep: int = RUNS_KEPT) -> DataFrame:
    return runs.join(retain_runs(runs, keep).select("id"), "id", "left_anti")


def cascade_delete(deleted: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Child tables without the rows of deleted runs. Rows without a run stay."""
    gone = deleted.select(F.col("id").alias("task_id"))
    return {name: child.join(gone, "task_id", "left_anti") for name, child in children.items()}


def list_runs(runs: DataFrame, status: str | None = None, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A page of ``size`` runs, newest first, each row with the ``total`` of matching runs."""
    if size < 1:
        raise ValueError(f"a page holds one run at least, not {size}")
    page = max(page, 1)
    found = runs.filter(F.col("status") == status) if status else runs
    total = found.agg(F.count("*").alias("total")).scalar()
    paged = found.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)
    return paged.withColumn("total", total)


def search_runs(runs: DataFrame, text: str) -> DataFrame:
    """Runs whose name contains ``text``, whatever the case."""
    return runs.filter(F.lower("name").contains(text.lower()))


def running_runs(runs: DataFrame, top: int = 3) -> DataFrame:
    return runs.filter(F.col("status") == "running").orderBy(F.desc("created_at"), F.desc("id")).limit(top)


def status_counts(runs: DataFrame) -> DataFrame:
    """One row: runs in total and per status."""
    per_status: list[Column] = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return runs.agg(F.count("*").alias("total"), *per_status)
