"""The migration as one job: scan, filter, merge, write, verify."""

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.operators.filters import KeyFilter, filter_keys, filter_verdict
from keyferry.operators.merge import merge_result, plan_merge
from keyferry.operators.progress import migration_summary, progress
from keyferry.operators.verify import sample_keys, verify_rows, verify_summary
from keyferry.session import scratch_path
from keyferry.sources.keyspace import key_snapshot, scan_keyspace
from keyferry.sources.writers import write_snapshot


@dataclass(frozen=True)
class MigrationOptions:
    rule: KeyFilter = KeyFilter()
    policy: str = "skip_full_only"
    # rows of the source that are verified afterwards; all without a number
    sample: int | None = None
    buckets: int = 64


class MigrationReport(NamedTuple):
    summary: DataFrame
    verification: DataFrame
    target: DataFrame


def migrate(
    spark: SparkSession, source_rows: DataFrame, target: DataFrame, path: str, options: MigrationOptions = MigrationOptions()
) -> MigrationReport:
    """Full load of a source scan into a target, written to the new version folder ``path``.

    The filtered, de-duplicated scan is written once to the shared scratch folder, because summary, merge
    and verification all need it and de-duplicating is the one step that shuffles source values. Summary
    and verification are DataFrames still to be run; the verification reads the written target.
    """
    rule, policy = options.rule, options.policy
    scan_path = scratch_path(spark, "scanned-source")
    scan_keyspace(filter_keys(source_rows, rule)).write.parquet(scan_path)
    source = spark.read.schema(schemas.KEYSPACE).parquet(scan_path)
    dropped = None
    if rule != KeyFilter():
        dropped = filter_verdict(key_snapshot(source_rows), rule).filter(~F.col("kept"))
    summary = progress(migration_summary(plan_merge(source, target, policy), dropped))
    write_snapshot(merge_result(source, target, policy), path, options.buckets)
    written = spark.read.parquet(path)
    if options.sample is None:
        checked = verify_rows(source, written)
    else:
        checked = verify_rows(sample_keys(source, options.sample), written, sample_size=options.sample)
    verification = verify_summary(checked)
    return MigrationReport(summary, verification, written)
