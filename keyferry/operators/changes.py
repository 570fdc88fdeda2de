"""Folding change events into a keyspace.

Events are ordered by (ts, offset, node_id). The fold keeps, per key, the last write (set or del) and
the last expire. Both are maxima, so folding is associative and repeated or late events do no harm.
Renames are settled before (``renames``): each becomes a del of the old key and a set of what that key held at the time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.functions.values import normal_ttl
from keyferry.operators.limits import few_enough
from keyferry.operators.renames import ORDER, settle_renames, steps_of
from keyferry.session import stored

# What a settled rename brings along besides value and TTL.
CARRIED = {"type": "string", "node": "int", "fallback": "string", "absent": "boolean"}


def _order(event: Column) -> Column:
    return F.struct(*[event[c].alias(c) for c in ORDER])


def fold_changes(changes: DataFrame) -> DataFrame:
    """Last write and last expire per key, as structs ``write`` and ``expire``.

    Every map task folds its own events first, so a key with very many events shuffles one row per task.
    Renames that were not settled before give a set without a value.
    """
    if "new_key" in changes.columns:
        op = F.when(F.col("op") == "move", "set").otherwise(F.col("op"))
        changes = steps_of(changes).withColumn("op", op)
    for name, kind in CARRIED.items():
        if name not in changes.columns:
            changes = changes.withColumn(name, F.lit(None).cast(kind))
    write = F.struct(*ORDER, "op", "value", "ttl_s", *CARRIED)
    expire = F.struct(*ORDER, "ttl_s")
    return changes.groupBy("key").agg(
        F.max(F.when(F.col("op").isin("set", "del"), write)).alias("write"),
        F.max(F.when(F.col("op") == "expire", expire)).alias("expire"),
    )


def merge_folds(folds: DataFrame) -> DataFrame:
    """Fold of folds: one row per key again."""
    return folds.groupBy("key").agg(F.max("write").alias("write"), F.max("expire").alias("expire"))


def apply_folds(
    target: DataFrame, folds: DataFrame, source: DataFrame | None = None, few: bool = False
) -> DataFrame:
    """Target after the folded changes.

    A set without a value takes value and type from ``source``, where the key lives now; if the source
    lacks it too, the target row stays, unless a rename found the key gone. An expire counts only after the last write.

    Pass ``few`` when few keys are expected to change. If a count finds their number and bytes small, they are
    broadcast to the target: its untouched rows pass through, and only the touched ones are shuffled.
    """
    target = target.select(schemas.KEYSPACE.names)
    if not few:
        return _changed(target.join(folds, "key", "full_outer"), source)
    # kept, since they are counted and then used twice
    folds = stored(folds, "folds")
    if not few_enough(folds):
        return _changed(target.join(folds, "key", "full_outer"), source)
    keys = F.broadcast(folds.select("key"))
    touched = folds.join(target.join(keys, "key", "left_semi"), "key", "left")
    if source is not None:
        source = source.join(keys, "key", "left_semi")
    return target.join(keys, "key", "left_anti").withColumn("ttl_s", normal_ttl(F.col("ttl_s"))).unionByName(
        _changed(touched, source)
    )


def _changed(joined: DataFrame, source: DataFrame | None) -> DataFrame:
    """Rows of the target joined with folds, after the change."""
    write, expire = F.col("write"), F.col("expire")
    if source is not None:
        lookup = source.select("key", F.col("value").alias("_value"), F.col("type").alias("_type"))
        joined = joined.join(lookup, "key", "left")
    else:
        joined = joined.withColumn("_value", F.lit(None).cast("string")).withColumn("_type", F.lit(None).cast("string"))

    is_set = F.coalesce(write["op"] == "set", F.lit(False))
    is_del = F.coalesce(write["op"] == "del", F.lit(False))
    looked_up = is_set & write["value"].isNull() & F.col("_value").isNotNull()
    known = ~F.coalesce(write["absent"], F.lit(False))
    new_value = F.coalesce(write["value"], F.col("_value"), write["fallback"], F.when(known, F.col("value")))
    written = F.when(is_set, new_value).otherwise(F.col("value"))
    expired = expire.isNotNull() & (write.isNull() | (_order(expire) > _order(write)))
    ttl = F.when(expired, expire["ttl_s"]).when(is_set, write["ttl_s"]).otherwise(F.col("ttl_s"))
    return joined.filter(~is_del & written.isNotNull()).select(
        "key",
        F.when(looked_up, F.col("_type")).otherwise(F.coalesce(write["type"], F.col("type"), F.lit("string"))).alias("type"),
        written.alias("value"),
        normal_ttl(ttl).alias("ttl_s"),
        F.coalesce(write["node"], F.col("node"), F.lit(0)).alias("node"),
    )


def apply_changes(
    target: DataFrame, changes: DataFrame, source: DataFrame | None = None, few: bool = False
) -> DataFrame:
    """Target after a log of set, del, expire and rename events."""
    return apply_folds(target, fold_changes(settle_renames(changes, target)), source, few)
