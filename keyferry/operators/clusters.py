"""Cluster totals and sizing advice for pairs of clusters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.functions.text import human_bytes, human_duration

KIB = 1024
MIB = 1024 * 1024
# Fixed values of the sizing rules. Tiers are (upper bound, value); the last has no bound.
MIN_FREE_CLIENTS = 100
CLIENTS_PER_WORKER = 3
WORKERS_PER_CORE = 4
WORKER_LIMITS = (4, 100)
WORKERS_BY_LOAD = [(1000, 100), (10_000, 50), (None, 20)]
IDLE_OPS = 100
ASSUMED_CAPACITY = 50_000
SOURCE_SHARE = 30
TARGET_SHARE = 50
MIN_CONNECTIONS = 10
SPEED_BY_KEY_SIZE = [(KIB, 500), (10 * KIB, 200), (100 * KIB, 50), (None, 10)]
OPERATIONS_PER_KEY = 4
SCAN_BATCH = 1000
LARGE_KEY_BYTES = 10 * MIB
LARGE_KEY_BYTES_LOWERED = 5 * MIB
REASONS_BY_LOAD = [(1000, "source load is low"), (10_000, "source load is medium"), (None, "source load is high")]
REASON_IDLE_SOURCE = "source is idle, no QPS limit"
REASON_SOURCE_QPS = "source QPS limited to 30%% of capacity (%d)"
REASON_IDLE_TARGET = "target is idle, no QPS limit"
REASON_LARGE_AVERAGE = "average key is large, threshold lowered"


def cluster_summary(nodes: DataFrame) -> DataFrame:
    """Totals per cluster over its nodes. The version is that of the smallest node address."""
    return (
        nodes.groupBy("cluster")
        .agg(
            F.sum("keys").alias("keys"),
            F.sum("used_memory").alias("used_memory"),
            F.max("max_memory").alias("max_memory"),
            F.sum("ops").alias("ops"),
            F.sum("clients").alias("clients"),
            F.max("max_clients").alias("max_clients"),
            F.count("*").alias("nodes"),
            F.min_by("version", "node").alias("version"),
        )
        .withColumn("avg_key_bytes", F.when(F.col("keys") > 0, F.expr("used_memory div keys")).otherwise(0))
        .withColumn("memory_text", human_bytes(F.col("used_memory")))
    )


def _tier(measure: Column, tiers: list) -> Column:
    chosen = F
    for bound, value in tiers:
        chosen = chosen.when(measure < bound, value) if bound is not None else chosen.otherwise(value)
    return chosen


def _qps(ops: Column, share: int) -> Column:
    capacity = F.greatest(ops * 2, F.lit(ASSUMED_CAPACITY))
    return F.when(ops < IDLE_OPS, 0).otherwise(F.floor(capacity * share / 100)).cast("long")


def recommend_config(clusters: DataFrame, pairs: DataFrame, cores: int) -> DataFrame:
    """Workers, QPS, connections, expected speed and time for rows (source, target) of cluster names."""
    source = clusters.select([F.col(c).alias(f"s_{c}") for c in clusters.columns])
    target = clusters.select([F.col(c).alias(f"t_{c}") for c in clusters.columns])
    joined = pairs.join(source, F.col("source") == F.col("s_cluster")).join(target, F.col("target") == F.col("t_cluster"))

    def free(side: str) -> Column:
        spare = F.col(f"{side}_max_clients") - F.col(f"{side}_clients")
        return F.greatest(spare, F.lit(MIN_FREE_CLIENTS)).cast("long")

    by_clients = F.floor(F.least("s_free", "t_free") / CLIENTS_PER_WORKER)
    wanted = F.least(F.lit(cores * WORKERS_PER_CORE), by_clients, _tier(F.col("s_ops"), WORKERS_BY_LOAD))
    low, high = WORKER_LIMITS
    unlimited_speed = _tier(F.col("s_avg_key_bytes"), SPEED_BY_KEY_SIZE) * F.col("workers")
    limited = (F.col("source_qps") > 0) & (F.col("source_qps") < unlimited_speed * OPERATIONS_PER_KEY)
    speed = F.when(limited, F.floor(F.col("source_qps") / OPERATIONS_PER_KEY)).otherwise(unlimited_speed)
    seconds = F.when((F.col("speed") > 0) & (F.col("s_keys") > 0), F.floor(F.col("s_keys") / F.col("speed")))
    large_average = F.col("s_avg_key_bytes") > MIB

    def connections(side: str) -> Column:
        own = F.least(F.col("workers") * CLIENTS_PER_WORKER, F.floor(F.col(f"{side}_free") / 2))
        return F.greatest(own, F.lit(MIN_CONNECTIONS)).cast("long")

    reasons = F.array_compact(
        F.array(
            _tier(F.col("s_ops"), REASONS_BY_LOAD),
            F.when(F.col("s_ops") < IDLE_OPS, REASON_IDLE_SOURCE).otherwise(
                F.format_string(REASON_SOURCE_QPS, "source_qps")
            ),
            F.when(F.col("t_ops") < IDLE_OPS, REASON_IDLE_TARGET),
            F.when(large_average, REASON_LARGE_AVERAGE),
        )
    )
    return (
        joined.withColumns({"s_free": free("s"), "t_free": free("t")})
        .withColumn("workers", F.greatest(F.least(wanted, F.lit(high)), F.lit(low)).cast("long"))
        .withColumns({"source_qps": _qps(F.col("s_ops"), SOURCE_SHARE), "target_qps": _qps(F.col("t_ops"), TARGET_SHARE)})
        .withColumn("speed", speed.cast("long"))
        .withColumn("seconds", seconds.cast("long"))
        .select(
            "source",
            "target",
            "workers",
            F.lit(SCAN_BATCH).alias("scan_batch"),
            "source_qps",
            "target_qps",
            connections("s").alias("source_connections"),
            connections("t").alias("target_connections"),
            F.when(large_average, LARGE_KEY_BYTES_LOWERED).otherwise(LARGE_KEY_BYTES).cast("long").alias("large_key_bytes"),
            "speed",
            "seconds",
            human_duration(F.col("seconds")).alias("time_text"),
            F.concat_ws("; ", reasons).alias("reasons"),
        )
    )
