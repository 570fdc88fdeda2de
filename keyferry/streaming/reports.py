"""Continuous reports: totals, throughput windows, liveness sessions and convergence."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyferry import schemas
from keyferry.functions.ranking import join_whole
from keyferry.operators.convergence import ConvergenceRule, convergence, stopping_iteration
from keyferry.streaming.sinks import POLL, Batches, read_batches, start

# Fixed intervals of the reports.
THROUGHPUT_WINDOW = "10 seconds"
SILENCE = "30 seconds"
# How far a beat may lie behind the newest one and still count for an alarm.
DELAY = "10 seconds"
# Width of the time ranges within which sessions are put in order.
SESSION_CHUNK_US = 6 * 3600 * 1_000_000


def _added(path: str, schema, merge=lambda rows: rows, shape=lambda batch: batch):
    """Handles micro-batches by adding their rows, in the given shape, to those under a path."""

    def handle(batch: DataFrame, query: str, batch_id: int) -> None:
        Batches(batch.sparkSession, path, schema, merge).add(shape(batch), query, batch_id)

    return handle


def _newest_totals(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("keys", "bytes", "errors"), "batch").alias("newest")
    return (
        rows.groupBy("task_id", "worker_id")
        .agg(newest, F.max("batch").alias("batch"))
        .select("task_id", "worker_id", "newest.*", "batch")
    )


def stream_progress(reports: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running totals per run and worker; each micro-batch writes the totals that changed."""
    totals = reports.groupBy("task_id", "worker_id").agg(
        F.sum("keys_processed").alias("keys"), F.sum("bytes_sent").alias("bytes"), F.sum("error_count").alias("errors")
    )
    return start(totals, _added(path, schemas.PROGRESS_TOTALS, _newest_totals), checkpoint, "update", trigger)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals of each run and worker."""
    return _newest_totals(read_batches(spark, path, schemas.PROGRESS_TOTALS)).drop("batch")


def window_sums(reports: DataFrame, slide: str | None = None) -> DataFrame:
    """Keys and bytes per run and window. A report without a time belongs to no window."""
    span = F.window("ts", THROUGHPUT_WINDOW, slide) if slide else F.window("ts", THROUGHPUT_WINDOW)
    return (
        reports.groupBy(span.alias("span"), "task_id")
        .agg(F.sum("keys_processed").alias("keys"), F.sum("bytes_sent").alias("bytes"))
        .select(_micros("span.start").alias("start_us"), _micros("span.end").alias("end_us"), "task_id", "keys", "bytes")
    )


def stream_throughput(
    reports: DataFrame, path: str, checkpoint: str, slide: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Write the window sums of each micro-batch.

    Sums of different batches add up, so there is neither state nor watermark, and no late report is lost.
    """
    handle = _added(path, schemas.THROUGHPUT, _summed, lambda batch: window_sums(batch, slide))
    return start(reports, handle, checkpoint, trigger=trigger)


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy("start_us", "end_us", "task_id").agg(
        F.sum("keys").alias("keys"), F.sum("bytes").alias("bytes"), F.max("batch").alias("batch")
    )


def read_throughput(spark: SparkSession, path: str) -> DataFrame:
    """Keys and bytes per run and window over all reports so far, the newest windows included."""
    return _summed(read_batches(spark, path, schemas.THROUGHPUT)).drop("batch")


def beat_sessions(beats: DataFrame, silence: str = SILENCE) -> DataFrame:
    """Sessions per worker: beats no more than ``silence`` apart; a session ends ``silence`` after its last beat."""
    return (
        beats.groupBy(F.session_window("ts", silence).alias("span"), "worker_id")
        .agg(F.count("*").alias("beats"))
        .select(_micros("span.start").alias("start_us"), _micros("span.end").alias("end_us"), "worker_id", "beats")
    )


def merge_sessions(parts: DataFrame, chunk_us: int = SESSION_CHUNK_US) -> DataFrame:
    """Sessions that overlap or touch joined, per worker.

    A part opens a session if it starts after all earlier ones of its worker have ended. Parts are ordered within
    chunks of time; what earlier chunks reach comes from one row per worker and chunk, so the parts of a busy worker
    never meet in one task.
    """
    parts = parts.withColumn("_chunk", F.floor(F.col("start_us") / chunk_us))
    inside = W.partitionBy("worker_id", "_chunk").orderBy("start_us", "end_us").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("worker_id", "_chunk").orderBy("start_us", "end_us").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("worker_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)

    def from_earlier(rows: DataFrame, column: str, name: str) -> DataFrame:
        newest = rows.groupBy("worker_id", "_chunk").agg(F.max(column).alias("_newest"))
        before = newest.select("worker_id", "_chunk", F.max("_newest").over(earlier).alias(name))
        return join_whole(rows, before, ["worker_id", "_chunk"])

    reached = from_earlier(parts, "end_us", "_reached")
    opens = F.coalesce(
        F.col("start_us") > F.greatest(F.col("_reached"), F.max("end_us").over(inside)), F.lit(True)
    )
    opened = from_earlier(reached.withColumn("_opened", F.when(opens, F.col("start_us"))), "_opened", "_open_before")
    first = F.coalesce(F.max("_opened").over(upto), F.col("_open_before"))
    return (
        opened.withColumn("_first", first)
        .groupBy("worker_id", F.col("_first").alias("start_us"))
        .agg(F.max("end_us").alias("end_us"), F.sum("beats").alias("beats"))
        .select("start_us", "end_us", "worker_id", "beats")
    )


def stream_sessions(
    beats: DataFrame, path: str, checkpoint: str, silence: str = SILENCE, trigger: dict | None = None
) -> StreamingQuery:
    """Write the sessions of each micro-batch; those of different batches are joined when they are read."""


    def merged(rows: DataFrame) -> DataFrame:
        return merge_sessions(rows.drop("batch")).withColumn("batch", rows.agg(F.max("batch")).scalar())

    handle = _added(path, schemas.SESSION, merged, lambda batch: beat_sessions(batch, silence))
    return start(beats, handle, checkpoint, trigger=trigger)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions over all beats so far, open ones included."""
    return merge_sessions(read_batches(spark, path, schemas.SESSION).drop("batch"))


def stream_silences(
    beats: DataFrame,
    path: str,
    checkpoint: str,
    silence: str = SILENCE,
    delay: str = DELAY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write one row whenever a worker falls silent: it gave no beat for ``silence`` while the stream's time went on.

    Event-time sessions per worker are the timers: a session is written when the watermark, ``delay`` behind the newest
    beat of any worker, passes its end, and its state is dropped. A beat that comes later than that raises no alarm and
    takes none back; ``stream_sessions`` keeps such beats.
    """
    sessions = beats.withWatermark("ts", delay).groupBy(F.session_window("ts", silence).alias("span"), "worker_id")
    silences = sessions.agg(F.count("*").alias("beats"), F.max("ts").alias("last")).select(
        "worker_id", F.unix_micros("last").alias("last_beat_us"), _micros("span.end").alias("silent_us"), "beats"
    )
    return start(silences, _added(path, schemas.SILENCE), checkpoint, trigger=trigger)


def read_silences(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, schemas.SILENCE).drop("batch")


def _micros(moment: str) -> Column:
    return F.unix_micros(F.col(moment))


def append_rows(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the rows of a stream to a parquet table."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or POLL))
        .start(path)
    )


def stream_convergence(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Collect the iteration records of the incremental loops."""
    return start(records, _added(path, schemas.CONVERGENCE), checkpoint, trigger=trigger)


def stop_signals(spark: SparkSession, path: str, rule: ConvergenceRule = ConvergenceRule()) -> DataFrame:
    """Per run the iteration at which its loop may stop, from the records collected so far."""
    return stopping_iteration(convergence(read_batches(spark, path, schemas.CONVERGENCE).drop("batch"), rule))
