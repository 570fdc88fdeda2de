"""Report texts: sizes, counts and durations."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(size: Column) -> Column:
    """``512 B``, ``1.50 KB``, ``3.00 MB``, ``2.25 GB``."""

    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.2f {unit}", size.cast("double") / F.lit(float(1024**power)))

    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def human_duration(seconds: Column) -> Column:
    """The two largest units: ``45s``, ``3m 20s``, ``2h 5m``, ``4d 7h``; null stays ``-``."""

    def pair(high: int, low: int, units: str) -> Column:
        return F.format_string(
            units, F.floor(seconds / high).cast("long"), F.floor((seconds % high) / low).cast("long")
        )

    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("-"))
        .when(seconds < 60, F.format_string("%ds", seconds.cast("long")))
        .when(seconds < 3600, pair(60, 1, "%dm %ds"))
        .when(seconds < 86400, pair(3600, 60, "%dh %dm"))
        .otherwise(pair(86400, 3600, "%dd %dh"))
    )
