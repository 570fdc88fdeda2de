"""Continuous incremental sync: new keys and change events."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructType

from keyferry import schemas
from keyferry.operators.changes import apply_changes
from keyferry.operators.filters import KeyFilter, filter_keys
from keyferry.operators.limits import few_enough
from keyferry.sources.keyspace import scan_keyspace
from keyferry.streaming.sinks import Batches, read_batches, start

#: Buckets of the known keys. A micro-batch reads those its keys fall into. One path needs one number all its life.
KEY_BUCKETS = 32


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def _new_rows(spark: SparkSession, path: str) -> Batches:
    schema = StructType([*schemas.KEYSPACE.fields]).add("bucket", IntegerType())
    return Batches(spark, path, schema, partition="bucket")


def _snapshots(spark: SparkSession, path: str) -> Batches:
    schema = StructType().add("key", StringType()).add("bucket", IntegerType())
    return Batches(spark, f"{path}/known", schema, partition="bucket")


def add_known(known: DataFrame, path: str) -> None:
    """Add the keys of a snapshot to the known ones under ``path``; keys that are known already are not stored again."""
    index = _snapshots(known.sparkSession, path)
    keys = known.select("key").distinct()
    held = index.manifest()
    if held["folders"]:
        keys = keys.join(index.read().select("key"), "key", "left_anti")
    index.add(keys.withColumn("bucket", key_bucket(F.col("key"))), "snapshots", held["next"])


def known_keys(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """Known keys of some buckets: those of the snapshots and those written so far. Other buckets are not read."""
    parts = [index.read().filter(F.col("bucket").isin(buckets)) for index in (_snapshots(spark, path), _new_rows(spark, path))]
    return parts[0].select("key", "bucket").unionByName(parts[1].select("key", "bucket"))


def stream_new_keys(
    rows: DataFrame,
    known: DataFrame,
    path: str,
    checkpoint: str,
    rule: KeyFilter = KeyFilter(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each key the first time the stream shows it, unless a snapshot has it.

    The known keys are those of the snapshots that the query was ever started with and those written so far, whichever
    checkpoint they came by; both lie in buckets by key. A snapshot is read once, when the query starts. A micro-batch
    reads the keys of its own buckets only, of which there is a fixed number; found small, it is broadcast to them. Copies
    within it are cut map-side. A replayed micro-batch that was written is left out, another one sees the same known keys.
    """
    add_known(known, path)

    def handle(batch: DataFrame, query: str, batch_id: int) -> None:
        spark = batch.sparkSession
        written = _new_rows(spark, path)
        if written.has(query, batch_id):
            return
        fresh = scan_keyspace(batch.select(*schemas.KEYSPACE.names)).withColumn("bucket", key_bucket(F.col("key"))).persist()
        try:
            buckets = [r.bucket for r in fresh.select("bucket").distinct().collect()]
            keys = fresh.select("key")
            if few_enough(keys):
                keys = F.broadcast(keys)
            seen = known_keys(spark, path, buckets).join(keys, "key", "left_semi").select("key").distinct()
            written.add(fresh.join(seen, "key", "left_anti"), query, batch_id)
        finally:
            fresh.unpersist()

    return start(filter_keys(rows, rule), handle, checkpoint, trigger=trigger)


def read_new_keys(spark: SparkSession, path: str) -> DataFrame:
    return _new_rows(spark, path).read().drop("batch", "bucket")


def stream_apply_changes(
    changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the change events of each micro-batch.

    They stay events, because a rename that comes late needs what its old key held at that time, which a fold may
    have passed over. Repeated events change nothing and an old one never beats a newer one, whichever batch brings
    it. So the stream needs neither state nor watermark and loses no late event.
    """
    columns = schemas.CHANGE.names

    def handle(batch: DataFrame, query: str, batch_id: int) -> None:
        Batches(batch.sparkSession, path, schemas.CHANGE).add(batch.select(columns), query, batch_id)

    return start(changes, handle, checkpoint, trigger=trigger)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The events of all batches so far."""
    return read_batches(spark, path, schemas.CHANGE).drop("batch")


def changed_target(spark: SparkSession, target: DataFrame, path: str, source: DataFrame | None = None) -> DataFrame:
    """The target with every change streamed so far."""
    return apply_changes(target, read_changes(spark, path), source, few=True)
