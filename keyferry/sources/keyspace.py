"""Keyspace scans, snapshots, sizes and generated keyspaces."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.functions.values import canonical_value

# The copy of a repeated key that is kept: the first in this order.
SCAN_ORDER = ["node", "type", "value", "ttl_s"]


def read_keyspace(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw keyspace rows from parquet, csv, json or orc files; keys may repeat."""
    return spark.read.format(fmt).schema(schemas.KEYSPACE).load(path)


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """Keys from text files with one key per line; empty lines do not count."""
    return spark.read.text(path).select(F.col("value").alias("key")).filter(F.length("key") > 0)


def scan_keyspace(rows: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """One row per key. Of differing rows of a key the first by ``order`` is kept.

    Spark cuts each partition to one row per key before the shuffle, so a key that repeats without end
    costs its partition a sort and the network one row.
    """
    first = F.row_number().over(W.partitionBy("key").orderBy(*(order or SCAN_ORDER)))
    return rows.withColumn("_copy", first).filter(F.col("_copy") == 1).drop("_copy")


def key_snapshot(rows: DataFrame) -> DataFrame:
    return rows.select("key").distinct()


def union_scans(*scans: DataFrame) -> DataFrame:
    """Distinct keys over the scans of several nodes."""
    return reduce(DataFrame.unionByName, [s.select("key") for s in scans]).distinct()


def keyspace_size(rows: DataFrame) -> DataFrame:
    """Keys per node, and in total where ``node`` is null."""
    return rows.rollup("node").agg(F.count("*").alias("keys"))


def generator_plan(
    spark: SparkSession,
    strings: int = 100_000,
    large: int = 10,
    hashes: int = 3000,
    lists: int = 1000,
    sets: int = 1000,
) -> DataFrame:
    """Rows (kind, id) for ``generate_keyspace``, in the proportions of the usual test keyspace."""
    counts = {"string": strings, "large": large, "hash": hashes, "list": lists, "set": sets}
    return reduce(
        DataFrame.unionByName, [spark.range(n).select(F.lit(kind).alias("kind"), "id") for kind, n in counts.items()]
    )


def generate_keyspace(
    plan: DataFrame, string_size: int = 4000, large_size: int = 5 * 1024 * 1024, item_size: int = 1000, items: int = 10
) -> DataFrame:
    """Synthetic keyspace rows for a plan of (kind, id).

    Texts are repeated MD5 digests of key and position, so the same plan always gives the same values.
    """
    name = {"string": "str_key_", "large": "large_str_", "hash": "hash_key_", "list": "list_key_", "set": "set_key_"}
    kind = F.col("kind")
    prefix = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in name.items()])
    key = F.concat(prefix, F.col("id").cast("string"))

    def filler(seed: Column, size: int) -> Column:
        return F.substring(F.repeat(F.md5(seed), size // 32 + 1), 1, size)

    numbers = F.sequence(F.lit(0), F.lit(items - 1))
    item = F.transform(numbers, lambda i: filler(F.concat_ws("#", F.col("key"), i.cast("string")), item_size))
    fields = F.transform(numbers, lambda i: F.concat(F.lit("field_"), i.cast("string")))
    shaped = plan.select(
        "kind",
        key.alias("key"),
        F.when(kind.isin("string", "large"), F.lit("string")).otherwise(kind).alias("type"),
    )
    value = canonical_value(
        F.col("type"),
        F.when(kind == "large", filler(F.col("key"), large_size)).otherwise(filler(F.col("key"), string_size)),
        F.map_from_arrays(fields, item),
        item,
        item,
        F.array().cast("array<struct<member:string,score:bigint>>"),
    )
    return shaped.select("key", "type", value.alias("value"), F.lit(-1).cast("long").alias("ttl_s"), F.lit(0).alias("node"))
