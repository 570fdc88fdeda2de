"""Node reports: ``name:value`` text lines per cluster node."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names of the node report and the columns they fill.
NUMBER_FIELDS = {
    "used_memory": "used_memory",
    "maxmemory": "max_memory",
    "instantaneous_ops_per_sec": "ops",
    "connected_clients": "clients",
}
VERSION_FIELD = "redis_version"
UNKNOWN_VERSION = "unknown"


def _field(info: Column, name: str) -> Column:
    """Text after ``name:`` on its own line, trimmed; null when the line is missing."""
    pattern = rf"(?m)^[ \t]*{name}:([^\r\n]*)"
    return F.when(info.rlike(pattern), F.trim(F.regexp_extract(info, pattern, 1)))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def scan_node_info(reports: DataFrame) -> DataFrame:
    """One row per (cluster, node) from report rows that each hold one or more sections.

    A number that is missing or unreadable is 0, a missing version is ``unknown``. Each text is read in
    its own row; only the parsed numbers are grouped.
    """
    info = F.col("info")
    parsed = reports.select(
        "cluster",
        "node",
        "keys",
        "maxclients",
        _field(info, VERSION_FIELD).alias("version"),
        *[_number(_field(info, name)).alias(column) for name, column in NUMBER_FIELDS.items()],
    )
    return parsed.groupBy("cluster", "node").agg(
        F.coalesce(F.max("keys"), F.lit(0)).alias("keys"),
        F.coalesce(F.max("maxclients"), F.lit(0)).alias("max_clients"),
        F.coalesce(F.max("version"), F.lit(UNKNOWN_VERSION)).alias("version"),
        *[F.coalesce(F.max(column), F.lit(0)).alias(column) for column in NUMBER_FIELDS.values()],
    )
