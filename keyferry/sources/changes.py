"""Change events as a stream of files."""

from pyspark.sql import DataFrame, SparkSession

from keyferry import schemas


def change_feed(
    spark: SparkSession, path: str, fmt: str = "parquet", schema=schemas.CHANGE, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of change events from files that keep arriving under ``path``.

    Events carry their order in (ts, offset, node_id); no operator relies on arrival order.
    ``files_per_trigger`` bounds the work of one micro-batch.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
