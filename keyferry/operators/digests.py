"""Comparing two keyspaces by a tree of digest sums.

A leaf of the tree is a part of a slot, and a node's digest is the sum of its rows' hashes, so rows may come in any order
and sums are formed where the rows lie. Two sides are compared slot by slot, then part by part within slots that differ;
only keys of parts that differ are brought together. Keys of all other parts are known to match without a shuffle. Tables
that are compared once and not stored by slot may use ranges of the key's own hash as slots, which need no Python.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from keyferry.functions.slots import SLOT_COUNT, slot, slot_bucket
from keyferry.functions.values import digest
from keyferry.session import scratch_path

#: Parts of a slot, and storage buckets of a digest table. One row per slot names the parts that differ.
PARTS = 256
BUCKETS = 64
COLUMNS = ["key", "type", "digest", "slot"]
#: Shares of the row hash, summed apart so that sums of two thousand million rows fit a long.
HALVES = ("high", "low")


def digest_rows(rows: DataFrame, hashed: bool = False) -> DataFrame:
    """``key``, ``type``, ``digest`` of the value and ``slot``; the value is read here and nowhere after.

    With ``hashed`` the slot is a range of the key's hash instead of its hash slot.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(SLOT_COUNT)).cast("int") if hashed else slot(F.col("key"))
    return rows.select("key", "type", digest(F.col("value")).alias("digest"), place.alias("slot"))


def _part() -> Column:
    """The part of a key within its slot; it uses other bits of the hash than a hashed slot."""
    return F.shiftrightunsigned(F.xxhash64("key"), 14).bitwiseAND(F.lit(PARTS - 1)).cast("int")


def write_digests(digests: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a digest table, partitioned by slot bucket, so that a comparison reads the buckets it descends into."""
    stored = digests.withColumn("slot_bucket", slot_bucket(F.col("slot"), buckets))
    stored.hint("rebalance", "slot_bucket").write.mode("error").partitionBy("slot_bucket").parquet(path)


def stored_digests(digests: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A digest table in the shared scratch folder."""
    path = scratch_path(digests.sparkSession, "digests")
    write_digests(digests, path, buckets)
    schema = StructType([*digests.schema.fields]).add("slot_bucket", IntegerType())
    return digests.sparkSession.read.schema(schema).parquet(path)


def _place(table: DataFrame) -> list[str]:
    return ["slot_bucket", "slot"] if "slot_bucket" in table.columns else ["slot"]


def _sides(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both sides in one table: ``side`` is 1 for the source and -1 for the target."""
    columns = [*COLUMNS, *_place(source)[:-1]]
    part = _part().alias("part")
    return source.select(*columns, part, F.lit(1).alias("side")).unionByName(
        target.select(*columns, part, F.lit(-1).alias("side"))
    )


def _compared(sides: DataFrame, by: list[str]) -> DataFrame:
    """Keys of either side per node, and whether their digest sums agree. Sums are formed map-side first."""
    row = F.xxhash64("key", "type", "digest")
    shares = {"high": F.shiftright(row, 32), "low": row.bitwiseAND(F.lit(0xFFFFFFFF))}
    sums = [F.sum(shares[h] * F.col("side")).alias(h) for h in HALVES]
    counted = sides.groupBy(*by).agg(
        F.count_if(F.col("side") == 1).alias("source_keys"), F.count_if(F.col("side") == -1).alias("target_keys"), *sums
    )
    same = (F.col("source_keys") == F.col("target_keys")) & (F.col("high") == 0) & (F.col("low") == 0)
    return counted.withColumn("same", same).drop(*HALVES)


def differing_slots(source: DataFrame, target: DataFrame) -> DataFrame:
    """Slots whose digest sums differ, with the keys of either side. At most one row per slot."""
    place = _place(source)
    return _compared(_sides(source, target), place).filter(~F.col("same")).drop("same")


def differing_parts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per differing slot the list ``parts`` of its differing parts: at most 16384 rows with 256 numbers each."""
    place = _place(source)
    slots = F.broadcast(differing_slots(source, target).select(*place))
    within = _sides(source, target).join(slots, place, "left_semi")
    parts = _compared(within, [*place, "part"]).filter(~F.col("same"))
    return parts.groupBy(*place).agg(F.collect_set("part").alias("parts"))


def compare_digests(source: DataFrame, target: DataFrame, with_matched: bool = True) -> DataFrame:
    """Every key of either side as ``matched``, ``mismatched``, ``missing`` or ``extra``; one row per key and its type.

    Both are digest tables with one row per key (``digest_rows``), stored alike. Keys of parts that agree are
    ``matched`` as they are read; ``with_matched=False`` leaves them out, and then only buckets that differ are read.
    Two parts whose 64-bit sums agree by chance would count as equal.
    """
    place = _place(source)
    parts = F.broadcast(differing_parts(source, target))
    differs = F.coalesce(F.array_contains("parts", _part()), F.lit(False))
    suspects = _sides(source, target).join(parts, place).filter(F.array_contains("parts", F.col("part")))
    of_source, of_target = F.col("side") == 1, F.col("side") == -1
    held = F.struct("type", "digest")
    per_key = suspects.groupBy("key").agg(
        F.max(F.when(of_source, held)).alias("source"), F.max(F.when(of_target, held)).alias("target")
    )
    status = (
        F.when(F.col("source").isNull(), "extra")
        .when(F.col("target").isNull(), "missing")
        .when(F.col("source").eqNullSafe(F.col("target")), "matched")
        .otherwise("mismatched")
    )
    found = per_key.select("key", F.coalesce("source.type", "target.type").alias("type"), status.alias("status"))
    if not with_matched:
        return found.filter(F.col("status") != "matched")
    agreeing = source.join(parts, place, "left").filter(~differs)
    return found.unionByName(agreeing.select("key", "type", F.lit("matched").alias("status")))


def range_report(source: DataFrame, target: DataFrame, ranges: int = BUCKETS) -> DataFrame:
    """Slot ranges of equal width: keys of either side, number of slots, and of those that differ."""
    slots = _compared(_sides(source, target), ["slot"])
    return slots.groupBy(slot_bucket(F.col("slot"), ranges).alias("range")).agg(
        F.sum("source_keys").alias("source_keys"),
        F.sum("target_keys").alias("target_keys"),
        F.count("*").alias("slots"),
        F.count_if(~F.col("same")).alias("differing_slots"),
    )
