"""Versions of a keyspace in slot buckets: a merge writes the buckets in which a key changes and keeps the others' files.

A version is a manifest that names one folder for each bucket. Reading a version, or a range of its slots, reads those
folders only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from keyferry import schemas
from keyferry.functions.slots import SLOT_COUNT, slot, slot_bucket
from keyferry.functions.values import digest, normal_ttl
from keyferry.operators.merge import effective_policy, merge_result
from keyferry.sources.manifest import Manifests

BUCKETS = 64
STORED = StructType([*schemas.KEYSPACE.fields]).add("slot_bucket", IntegerType())


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select(*schemas.KEYSPACE.names, slot_bucket(slot(F.col("key")), buckets).alias("slot_bucket"))


def _write(rows: DataFrame, path: str, version: int, buckets: list[int]) -> dict[str, str]:
    """Write bucketed rows as the folders of a version; a bucket without rows has no files in its folder."""
    folder = f"data/version={version}"
    rows.hint("rebalance", "slot_bucket").write.mode("overwrite").partitionBy("slot_bucket").parquet(f"{path}/{folder}")
    return {str(b): f"{folder}/slot_bucket={b}" for b in buckets}


def _latest(table: Manifests) -> tuple[int, dict]:
    versions = table.versions()
    if not versions:
        raise FileNotFoundError(f"no version under {table.path}")
    return versions[-1], table.read(versions[-1])


def write_version(keyspace: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Write a keyspace as a new version with all its buckets; returns the version's number."""
    table = Manifests(keyspace.sparkSession, path)
    version = max(table.versions(), default=-1) + 1
    rows = _bucketed(keyspace, buckets)
    folders = _write(rows, path, version, list(range(buckets)))
    table.commit({"buckets": buckets, "folders": folders}, version)
    return version


def _existing(table: Manifests, folders: list[str]) -> list[str]:
    """Folders that hold files: Spark writes none for a bucket without rows."""
    found = []
    for name in folders:
        files, at = table._files(name)
        if files.exists(at):
            found.append(f"{table.path}/{name}")
    return found


def read_version(
    spark: SparkSession, path: str, version: int | None = None, slots: tuple[int, int] | None = None
) -> DataFrame:
    """A version of the keyspace, the newest by default, or its keys in a range of slots.

    Only folders of buckets that the range touches are read; a bucket that lies wholly in the range needs no slot.
    """
    table = Manifests(spark, path)
    held = table.read(version) if version is not None else _latest(table)[1]
    first, last = slots or (0, SLOT_COUNT - 1)
    low, high = (s * held["buckets"] // SLOT_COUNT for s in (first, last))
    wanted = [name for b, name in held["folders"].items() if low <= int(b) <= high]
    paths = _existing(table, wanted)
    if not paths:
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).option("basePath", f"{path}/data").parquet(*paths).select(STORED.names)
    if slots is None:
        return rows
    width = SLOT_COUNT / held["buckets"]
    inside = [b for b in range(low, high + 1) if b * width >= first and (b + 1) * width - 1 <= last]
    return rows.filter(F.col("slot_bucket").isin(inside) | slot(F.col("key")).between(first, last))


def changed_buckets(source: DataFrame, target: DataFrame, policy: str, phase: str, buckets: int) -> list[int]:
    """Buckets in which a merge changes a row. Keys, digests and TTLs meet, values stay; at most one number per bucket."""
    policy = effective_policy(policy, phase)

    def short(rows: DataFrame, name: str) -> DataFrame:
        held = F.struct("type", digest(F.col("value")).alias("digest"), normal_ttl(F.col("ttl_s")).alias("ttl_s"), "node")
        return rows.select("key", held.alias(name))

    moved = short(source.filter(F.col("value").isNotNull()), "new").join(short(target, "old"), "key", "left")
    changes = F.col("old").isNull() if policy != "replace" else ~F.col("new").eqNullSafe(F.col("old"))
    found = moved.filter(changes).select(slot_bucket(slot(F.col("key")), buckets).alias("b")).distinct()
    return sorted(r.b for r in found.collect())


def merge_version(source: DataFrame, path: str, policy: str = "skip_full_only", phase: str = "full") -> int:
    """Merge a source with the newest version and write the result as the next one; returns its number.

    Rows are as ``merge_result`` gives them. Buckets in which nothing changes keep their folders: their values are read
    for digests when a key of theirs is merged over, and never written. A job that fails leaves the old version in place.
    """
    spark = source.sparkSession
    table = Manifests(spark, path)
    version, held = _latest(table)
    target = read_version(spark, path, version)
    buckets = changed_buckets(source, target, policy, phase, held["buckets"])
    folders = dict(held["folders"])
    if buckets:
        of_source = _bucketed(source, held["buckets"]).filter(F.col("slot_bucket").isin(buckets))
        merged = merge_result(of_source, target.filter(F.col("slot_bucket").isin(buckets)), policy, phase)
        folders |= _write(_bucketed(merged, held["buckets"]), path, version + 1, buckets)
    table.commit({"buckets": held["buckets"], "folders": folders}, version + 1)
    return version + 1


def expire_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Remove all but the newest ``keep`` versions and the folders that only they name."""
    table = Manifests(spark, path)
    versions = table.versions()
    gone, kept = versions[: max(len(versions) - keep, 0)], versions[max(len(versions) - keep, 0) :]
    live = {name for v in kept for name in table.read(v)["folders"].values()}
    for version in gone:
        for name in set(table.read(version)["folders"].values()) - live:
            table.delete(name)
        table.delete(f"manifest/{version}")
