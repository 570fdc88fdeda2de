"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings the jobs are written for. Sizes (shuffle partitions, memory) belong to the cluster.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    # sessions of one worker are merged map-side before they meet
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # window and session state on disk, not on the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the recommended settings on a running session and return it."""
    for name, value in RECOMMENDED_CONF.items():
        spark.conf.set(name, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder name for tables a job writes and reads back.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own, because there driver and executors share one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="keyferry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the scratch folder and read back: computed once, of known size, and without their lineage."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_with_count(rows: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """``stored``, and how many rows meet the condition, counted as they are written."""
    seen = Observation()
    found = stored(rows.observe(seen, F.count_if(condition).alias("rows")), name)
    return found, seen.get["rows"]
