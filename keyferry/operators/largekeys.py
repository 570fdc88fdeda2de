"""Large values: finding them, cutting them into parts and following the parts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.functions.ranking import top_rows
from keyferry.functions.values import digest, octets

DEFAULT_THRESHOLD = 10 * 1024 * 1024
DEFAULT_PART = 1024 * 1024


def large_keys(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD, top: int | None = None) -> DataFrame:
    """Keys with at least ``threshold`` bytes, the largest first; only the ``top`` ones if given."""
    large = rows.select("key", "type", octets(F.col("value")).alias("bytes")).filter(F.col("bytes") >= threshold)
    order = [F.desc("bytes"), F.col("key")]
    if top is None:
        return large.orderBy(*order)
    return top_rows(large, order, top, bucket=F.floor(F.col("bytes") / 65536), bucket_desc=True)


def large_key_counts(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    large = rows.filter(octets(F.col("value")) >= threshold)
    return large.groupBy("type").agg(F.count("*").alias("keys"), F.sum(octets(F.col("value"))).alias("bytes"))


def split_large_values(rows: DataFrame, threshold: int = DEFAULT_THRESHOLD, part_bytes: int = DEFAULT_PART) -> DataFrame:
    """Numbered parts of ``part_bytes`` bytes, each with its MD5.

    A value is turned into bytes once and cut at all offsets before the parts become rows; with the cast
    after the explode, every part would copy the whole value again.
    """
    sized = rows.withColumn("total_bytes", octets(F.col("value"))).filter(F.col("total_bytes") >= threshold)
    last = F.floor((F.greatest(F.col("total_bytes"), F.lit(1)) - 1) / part_bytes).cast("int")

    def cut(data: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.substring(data, n * part_bytes + 1, part_bytes))

    # an element of an array is evaluated once for all uses in the function
    pieces = F.transform(F.array(F.col("value").cast("binary")), cut)[0]
    return (
        sized.select("key", "type", "total_bytes", (last + 1).alias("parts"), F.posexplode(pieces).alias("part_no", "data"))
        .withColumn("part_bytes", F.octet_length("data").cast("long"))
        .withColumn("checksum", digest(F.col("data")))
    )


def large_key_progress(manifest: DataFrame, received: DataFrame) -> DataFrame:
    """How much of each large key has arrived: ``pending``, ``partial`` or ``done``.

    ``manifest`` and ``received`` are part rows. A part counts when the checksum of the bytes received
    equals the planned one; parts sent twice count once. Values are never put together again, so one
    huge key is checked by many tasks.
    """
    planned = manifest.select("key", "total_bytes", "parts", "part_no", "part_bytes", "checksum")
    arrived = (
        received.select("key", "part_no", digest(F.col("data")).alias("checksum"))
        .distinct()
        .withColumn("_arrived", F.lit(True))
    )
    matched = planned.join(arrived, ["key", "part_no", "checksum"], "left")
    good = F.col("_arrived").isNotNull()
    done = F.col("parts_done") == F.col("parts")
    return (
        matched.groupBy("key", "total_bytes", "parts")
        .agg(
            F.count_if(good).alias("parts_done"),
            F.sum(F.when(good, F.col("part_bytes")).otherwise(0)).alias("transferred_bytes"),
        )
        .withColumn("status", F.when(done, "done").when(F.col("parts_done") == 0, "pending").otherwise("partial"))
    )
