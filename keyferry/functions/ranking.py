"""Exact ranking that never brings a large group into one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Up to this many rows a plain top-k sends at most this many rows per partition to the last task. The rows are the same.
DIRECT_LIMIT = 100


def top_rows(df: DataFrame, order: list[Column], k: int, bucket: Column, bucket_desc: bool = False) -> DataFrame:
    """The first ``k`` rows of ``df`` by ``order``.

    ``bucket`` must grow (or fall, with ``bucket_desc``) along the leading order column. Null values come first in
    rising and last in falling order, as a bucket of their own. For a large ``k`` one counting pass over the buckets finds the last bucket the result can reach, so the final sort gets
    about ``k`` rows instead of ``k`` from every partition.
    """
    if k > DIRECT_LIMIT:
        counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"))
        by_bucket = W.orderBy(F.desc("bucket") if bucket_desc else F.asc("bucket"))
        before = F.sum("rows").over(by_bucket.rowsBetween(W.unboundedPreceding, -1))
        reached = counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < k)
        last = reached.agg((F.min if bucket_desc else F.max)("bucket").alias("last")).scalar()
        nulls = reached.agg(F.coalesce(F.bool_or(F.col("bucket").isNull()), F.lit(False)).alias("nulls")).scalar()
        df = df.filter((bucket >= last if bucket_desc else bucket <= last) | (bucket.isNull() & nulls))
    return df.orderBy(*order).limit(k)


def first_per_group(df: DataFrame, group: str, order: list[str], k: int, bucket: Column) -> DataFrame:
    """The first ``k`` rows of every group by the columns ``order``, which must be unique in a group.

    ``bucket`` must grow along the leading order column, whose null values come first. A small ``k`` is cut map-side. For a
    large one the rows per group and bucket are counted first, and only buckets the result can reach are
    ranked, so a group with a large share of all rows never meets in one task.
    """
    if k > DIRECT_LIMIT:
        counts = df.groupBy(group, bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
        earlier = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        reached = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        last = reached.filter(F.col("_before") < k).groupBy(group).agg(F.max("_bucket").alias("_last"))
        df = join_whole(df, last, [group])
        df = df.filter(bucket.isNull() | (bucket <= F.col("_last"))).drop("_last")
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def join_whole(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null, keeping the columns of ``df`` and the new ones of ``other``."""
    other = other.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return df.join(other, same).drop(*[f"_of_{key}" for key in keys])


def with_position(df: DataFrame, group: str, order: str, block: int) -> DataFrame:
    """Add ``position``, the 1-based rank of a row in its group by the whole-number column ``order``.

    Rows are ranked within blocks of ``block`` order values; the number of rows before a block comes from
    the block counts, so only those counts, not the rows, of one group meet in a task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocked.groupBy(group, "_block").agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(group, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(group, "_block").orderBy(order))
    return (
        join_whole(blocked.withColumn("_local", local), before, [group, "_block"])
        .withColumn("position", (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_block", "_local", "_before")
    )
