"""Key filters by prefix, pattern, substring or key list."""

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.functions.slots import SLOT_COUNT, slot

MODES = ("all", "prefix", "pattern", "contains", "keys")


@dataclass(frozen=True)
class KeyFilter:
    """Which keys take part. Exclusions come first in every mode; an empty include list keeps all.

    ``pattern`` is an unanchored regular expression, ``contains`` plain text. In ``keys`` mode an empty
    list keeps nothing. ``key_table`` and ``exclude_table`` hold lists too long for a literal.
    """

    mode: str = "all"
    include: list[str] = field(default_factory=list)
    exclude_prefixes: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    key_table: DataFrame | None = None
    exclude_table: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        for pattern in [*self.exclude_patterns, *(self.include if self.mode == "pattern" else [])]:
            _check(pattern)


def _check(pattern: str) -> None:
    """Refuse a pattern that Spark cannot match with."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            # a constant row: folded while the plan is made, no job
            spark.sql("SELECT 1").select(F.lit("").rlike(pattern)).collect()
        except PySparkException as error:
            raise ValueError(f"invalid pattern {pattern!r}") from error


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def _starts(key: Column, prefixes: list[str]) -> Column:
    return _any([key.startswith(p) for p in prefixes])


def _matches(key: Column, patterns: list[str]) -> Column:
    return key.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def included(key: Column, rule: KeyFilter) -> Column:
    """Whether the include rule alone, without exclusions or tables, keeps a key."""
    if rule.mode == "keys":
        return key.isin(rule.include) if rule.include else F.lit(False)
    if rule.mode == "all" or not rule.include:
        return F.lit(True)
    if rule.mode == "prefix":
        return _starts(key, rule.include)
    if rule.mode == "contains":
        return _any([key.contains(text) for text in rule.include])
    return _matches(key, rule.include)


def filter_keys(rows: DataFrame, rule: KeyFilter) -> DataFrame:
    """Rows whose key passes the filter.

    Prefix and list conditions on a stored key column reach the parquet scan. Key tables are reduced to
    distinct keys and joined; Spark broadcasts them when their size allows.
    """
    key = F.col("key")
    if rule.exclude_prefixes:
        rows = rows.filter(~_starts(key, rule.exclude_prefixes))
    if rule.exclude_patterns:
        rows = rows.filter(~_matches(key, rule.exclude_patterns))
    if rule.exclude_table is not None:
        rows = rows.join(rule.exclude_table.select("key").distinct(), "key", "left_anti")
    if rule.mode == "keys" and rule.key_table is not None:
        listed = rule.key_table.select("key").distinct()
        if rule.include:
            listed = rows.filter(included(key, rule)).select("key").unionByName(listed).distinct()
        return rows.join(listed, "key", "left_semi")
    return rows.filter(included(key, rule)) if rule.mode != "all" else rows


def filter_verdict(rows: DataFrame, rule: KeyFilter) -> DataFrame:
    """Add ``rule``, the first rule that decides a key, and ``kept``."""
    key = F.col("key")
    listed = included(key, rule)
    out = F.lit(False)
    if rule.exclude_table is not None:
        marked = rule.exclude_table.select("key").distinct().withColumn("_excluded", F.lit(True))
        rows = rows.join(marked, "key", "left")
        out = F.coalesce(F.col("_excluded"), F.lit(False))
    if rule.mode == "keys" and rule.key_table is not None:
        marked = rule.key_table.select("key").distinct().withColumn("_listed", F.lit(True))
        rows = rows.join(marked, "key", "left")
        listed = listed | F.coalesce(F.col("_listed"), F.lit(False))
    open_include = rule.mode == "all" or (rule.mode != "keys" and not rule.include)
    verdict = (
        F.when(_starts(key, rule.exclude_prefixes), "exclude_prefix")
        .when(_matches(key, rule.exclude_patterns), "exclude_pattern")
        .when(out, "exclude_table")
        .when(listed, "keep_all" if open_include else f"include_{rule.mode}")
        .otherwise("not_included")
    )
    return (
        rows.withColumn("rule", verdict)
        .withColumn("kept", F.col("rule").startswith("include") | (F.col("rule") == "keep_all"))
        .drop("_excluded", "_listed")
    )


def filter_report(rows: DataFrame, rule: KeyFilter) -> DataFrame:
    """Number of keys kept or dropped by each rule."""
    return filter_verdict(rows, rule).groupBy("rule", "kept").agg(F.count("*").alias("keys"))


def select_in_slots(
    rows: DataFrame, first: int, last: int | None = None, strict_tag: bool = False, buckets: int | None = None
) -> DataFrame:
    """Rows whose slot lies in [first, last]; one slot when ``last`` is omitted.

    Uses a stored ``slot`` column when there is one. For a snapshot stored by ``slot_bucket`` pass its number of
    ``buckets``: folders of other buckets are then not read.
    """
    position = F.col("slot") if "slot" in rows.columns else slot(F.col("key"), strict_tag)
    if buckets is not None:
        low, high = (s * buckets // SLOT_COUNT for s in (first, first if last is None else last))
        rows = rows.filter(F.col("slot_bucket").between(low, high))
    return rows.filter(position.between(first, first if last is None else last))
