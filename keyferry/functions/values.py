"""Sizes, digests and the canonical text of typed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(value: Column) -> Column:
    return F.octet_length(value).cast("long")


def digest(value: Column) -> Column:
    return F.md5(value)


def normal_ttl(ttl_s: Column) -> Column:
    """TTL in seconds as stored in a target: no or negative expiry is 0."""
    return F.greatest(F.coalesce(ttl_s, F.lit(0)), F.lit(0)).cast("long")


def canonical_value(
    kind: Column, string: Column, hash_: Column, list_: Column, set_: Column, zset: Column
) -> Column:
    """One comparable text per typed value: JSON with every free order fixed.

    Hash entries are in field order, set members in member order, zset members in (score, member) order;
    lists keep their own order.
    """
    scored = F.transform(zset, lambda m: F.struct(m["score"].alias("score"), m["member"].alias("member")))
    return (
        F.when(kind == "hash", F.to_json(F.sort_array(F.map_entries(hash_))))
        .when(kind == "list", F.to_json(list_))
        .when(kind == "set", F.to_json(F.sort_array(set_)))
        .when(kind == "zset", F.to_json(F.sort_array(scored)))
        .otherwise(string)
    )
