"""Size bounds for broadcasting keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to so many keys, and so many bytes of them, may be broadcast.
BROADCAST_KEYS = 50_000
BROADCAST_BYTES = 64 * 1024 * 1024


def few_enough(keys: DataFrame) -> bool:
    """Whether the keys of a DataFrame may be broadcast. Runs a count."""
    size = keys.agg(F.count("*").alias("keys"), F.sum(F.octet_length("key")).alias("bytes")).first()
    return size["keys"] <= BROADCAST_KEYS and (size["bytes"] or 0) <= BROADCAST_BYTES
