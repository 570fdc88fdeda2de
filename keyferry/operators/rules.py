"""Stored options of runs as data: decoding them, and filtering a keyspace for all runs at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry.operators.merge import POLICIES
from keyferry.session import stored

# The stored options' names and what holds where they say nothing.
OPTIONS = """
  worker_count INT, scan_batch_size INT, large_key_threshold BIGINT, conflict_policy STRING,
  skip_full_sync BOOLEAN, skip_incremental BOOLEAN,
  key_filter STRUCT<mode: STRING, prefixes: ARRAY<STRING>, patterns: ARRAY<STRING>, keys: ARRAY<STRING>,
    exclude_prefixes: ARRAY<STRING>, exclude_patterns: ARRAY<STRING>>
"""
DEFAULT_POLICY = "skip_full_only"
# Keys in order that meet spans together.
KEY_BLOCK = 4096


def decode_options(runs: DataFrame) -> DataFrame:
    """``id`` and the options in ``config``, the run's JSON: missing or unreadable ones take their defaults.

    ``mode`` is ``all`` if the filter names nothing to include; an unknown policy is the default one.
    """
    read = F.from_json("config", OPTIONS)
    rule = read["key_filter"]

    def listed(name: str) -> Column:
        return F.coalesce(F.filter(rule[name], lambda t: t.isNotNull()), F.array().cast("array<string>"))

    names = {"prefix": "prefixes", "pattern": "patterns", "keys": "keys"}
    # a list of keys that is empty keeps nothing, other empty lists keep all
    known = F.coalesce(*[F.when((rule["mode"] == m) & ((F.size(listed(n)) > 0) | F.lit(m == "keys")), m) for m, n in names.items()])
    policy = read["conflict_policy"]
    return runs.select(
        "id",
        F.coalesce(known, F.lit("all")).alias("mode"),
        *[listed(n).alias(n) for n in ("prefixes", "patterns", "keys", "exclude_prefixes", "exclude_patterns")],
        F.when(policy.isin(*POLICIES), policy).otherwise(DEFAULT_POLICY).alias("conflict_policy"),
        F.coalesce(read["skip_full_sync"], F.lit(False)).alias("skip_full_sync"),
        F.coalesce(read["skip_incremental"], F.lit(False)).alias("skip_incremental"),
    )


def _wanted(options: DataFrame) -> DataFrame:
    """``run_id`` and the ranges of keys, as bytes from ``low`` up to ``high``, that its filter names: ``wants`` or ``bans`` is 1.

    No text holds the byte 255, so the keys that begin with a prefix lie between the prefix and itself with that byte.
    """

    def ranges(texts: Column, end: bytes, wants: int) -> Column:
        return F.transform(
            texts,
            lambda t: F.struct(
                t.cast("binary").alias("low"),
                F.concat(t.cast("binary"), F.lit(end)).alias("high"),
                F.lit(wants).alias("wants"),
                F.lit(1 - wants).alias("bans"),
            ),
        )

    patterns = (F.col("mode") == "pattern") | (F.size("exclude_patterns") > 0)
    refused = F.raise_error(F.concat(F.lit("run with patterns: "), F.col("id")))
    # the check stays in the plan, since it decides the id
    options = options.withColumn("run_id", F.when(patterns, refused).otherwise(F.col("id")).cast("string"))
    included = (
        F.when(F.col("mode") == "prefix", ranges(F.col("prefixes"), b"\xff", 1))
        .when(F.col("mode") == "all", ranges(F.array(F.lit("")), b"\xff", 1))
        .when(F.col("mode") == "keys", ranges(F.col("keys"), b"\0", 1))
    )
    return options.select("run_id", F.inline(F.concat(included, ranges(F.col("exclude_prefixes"), b"\xff", 0))))


def _positions(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``at`` and ``position``, the number of smaller keys, of every distinct key (``is_key``) and every end of a range."""
    keys = rows.where(F.col("key").isNotNull()).select(F.col("key").cast("binary").alias("at"), F.lit(True).alias("is_key"))
    ends = wanted.select(F.explode(F.array("low", "high")).alias("at"), F.lit(False).alias("is_key"))
    # an end comes before the key that equals it
    ordered = keys.unionByName(ends).distinct().repartitionByRange("at", "is_key").sortWithinPartitions("at", "is_key")
    # a task's number stands in the upper bits; stored, so that both passes see the same tasks
    ordered = stored(ordered.withColumn("_place", F.monotonically_increasing_id()), "key-order")
    ordered = ordered.withColumn("_part", F.shiftright("_place", 33))
    counts = ordered.groupBy("_part").agg(F.count_if("is_key").alias("_keys"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_keys").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    # a row for each task
    numbered = ordered.withColumn("_inside", F.count_if("is_key").over(inside)).join(F.broadcast(before), "_part")
    return stored(numbered.select("at", "is_key", (F.col("_before") + F.col("_inside")).alias("position")), "key-positions")


def _kept_spans(rows: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``run_id``, ``first`` and ``end`` of the runs of positions that its filter keeps; and each ``key``'s ``position``.

    The ranges that one run names are few, they come from one row; those of all runs only meet the positions of their ends.
    """
    wanted = _wanted(options)
    positions = _positions(rows, wanted)
    ends = F.array(
        F.struct(F.col("low").alias("at"), F.col("wants"), F.col("bans")),
        F.struct(F.col("high").alias("at"), (-F.col("wants")).alias("wants"), (-F.col("bans")).alias("bans")),
    )
    steps = (
        wanted.select("run_id", F.inline(ends))
        .join(positions.where("NOT is_key").select("at", "position"), "at")
        .groupBy("run_id", "position")
        .agg(F.sum("wants").alias("wants"), F.sum("bans").alias("bans"))
    )
    along = W.partitionBy("run_id").orderBy("position")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    spans = steps.select(
        "run_id",
        F.col("position").alias("first"),
        F.lead("position").over(along).alias("end"),
        ((F.sum("wants").over(upto) > 0) & (F.sum("bans").over(upto) == 0)).alias("kept"),
    )
    keys = positions.where("is_key").select(F.col("at").cast("string").alias("key"), "position")
    return spans.where("kept AND end IS NOT NULL").drop("kept"), keys


def keys_of_runs(rows: DataFrame, options: DataFrame) -> DataFrame:
    """``run_id`` and ``key`` for every run and every key of ``rows`` that the run's filter keeps.

    ``options`` are decoded ones without patterns; a pattern is no range of keys, so runs with patterns are an error
    and are filtered one by one. All keys are put in order once. Prefixes are ranges of that order, and what a run keeps
    are spans of positions; spans meet the keys block by block, no key is held against every run. These are as many
    rows as all runs keep together: where totals will do, ``totals_of_runs`` does not list them.
    """
    spans, keys = _kept_spans(rows, options)

    def block(position: Column) -> Column:
        return F.floor(position / KEY_BLOCK)

    cut = spans.withColumn("_block", F.explode(F.sequence(block(F.col("first")), block(F.col("end") - 1))))
    met = cut.join(keys.withColumn("_block", block(F.col("position"))), "_block")
    return met.where("position >= first AND position < end").select("run_id", "key")


def totals_of_runs(rows: DataFrame, options: DataFrame) -> DataFrame:
    """``run_id``, number of ``keys``, ``first_key`` and ``last_key`` of what each run's filter keeps, if that is any key.

    The totals of ``keys_of_runs``, from the lengths of its spans: work grows with keys and prefixes, not with the keys
    that all runs keep.
    """
    spans, keys = _kept_spans(rows, options)
    totals = spans.groupBy("run_id").agg(
        F.sum(F.col("end") - F.col("first")).alias("keys"), F.min("first").alias("first"), (F.max("end") - 1).alias("last")
    )
    outer = totals.select("run_id", "keys", F.explode(F.array("first", "last")).alias("position")).join(keys, "position")
    return outer.groupBy("run_id").agg(
        F.max("keys").alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )
