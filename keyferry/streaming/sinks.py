"""Replay-safe folders of micro-batches, merged by levels so that their number stays small.

Every micro-batch is a folder of its own. A manifest names the folders that count; it is replaced by one rename, so
readers see a micro-batch, or the result of a merge, whole or not at all. ``FANOUT`` folders of a level are merged into one
of the next, so that after n micro-batches about ``FANOUT * log(n)`` folders are read. A micro-batch that the manifest
already holds is not written again, and a merge that failed half-way is repeated from the same folders.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from keyferry.sources.manifest import Manifests

# The usual polling interval of the incremental loop.
POLL = {"processingTime": "3 seconds"}
#: Folders of one level that are merged into one of the next.
FANOUT = 16
#: Manifests that are kept, and with them the folders they name, for readers that have just begun.
KEPT = 3


def _union(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class Batches:
    """The micro-batches under a path. ``merge`` makes one table of several; it must give the same rows for any grouping.

    Rows have the column ``batch``, which numbers the micro-batches in the order in which they were added, over restarts
    and new checkpoints too. ``partition`` names a column by which each folder is laid out.
    """

    spark: SparkSession
    path: str
    schema: StructType
    merge: Callable[[DataFrame], DataFrame] = _union
    partition: str | None = None

    @property
    def _table(self) -> Manifests:
        return Manifests(self.spark, self.path)

    def manifest(self) -> dict:
        """``next``, the number of the next micro-batch, ``done``, the newest one of each query, and the ``folders``."""
        versions = self._table.versions()
        return self._table.read(versions[-1]) if versions else {"next": 0, "done": {}, "folders": []}

    def folders(self) -> list[str]:
        return [f"{self.path}/{folder['name']}" for folder in self.manifest()["folders"]]

    def _read(self, names: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("batch", LongType())
        if not names:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{name}" for name in names]
        # folders that are laid out by a column are tables of their own
        tables = [[p] for p in paths] if self.partition else [paths]
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(*some) for some in tables])

    def read(self) -> DataFrame:
        """The rows of all micro-batches, as merged so far."""
        return self._read([folder["name"] for folder in self.manifest()["folders"]])

    def _write(self, rows: DataFrame, name: str) -> None:
        if self.partition:
            rows.hint("rebalance", self.partition).write.mode("overwrite").partitionBy(self.partition).parquet(
                f"{self.path}/{name}"
            )
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def has(self, query: str, batch_id: int) -> bool:
        return batch_id <= self.manifest()["done"].get(query, -1)

    def add(self, rows: DataFrame, query: str, batch_id: int) -> None:
        """Add the rows of a micro-batch of a query, unless they were added before; then merge what is due."""
        held = self.manifest()
        if batch_id <= held["done"].get(query, -1):
            return
        number = held["next"]
        self._write(rows.withColumn("batch", F.lit(number).cast("long")), f"data/0-{number}")
        folders = [*held["folders"], {"level": 0, "name": f"data/0-{number}"}]
        level, made = 0, {f"data/0-{number}"}
        while len(due := [f for f in folders if f["level"] == level]) >= FANOUT:
            level += 1
            merged = {"level": level, "name": f"data/{level}-{number}"}
            self._write(self.merge(self._read([f["name"] for f in due])), merged["name"])
            folders = [f for f in folders if f not in due] + [merged]
            made.add(merged["name"])
        self._commit({"next": number + 1, "done": held["done"] | {query: batch_id}, "folders": folders})
        # what was merged at once no manifest ever named
        for name in made - {f["name"] for f in folders}:
            self._table.delete(name)

    def _commit(self, manifest: dict) -> None:
        table = self._table
        versions = table.versions()
        version = max(versions, default=-1) + 1
        table.commit(manifest, version)
        gone, kept = versions[: -KEPT + 1], versions[-KEPT + 1 :]
        live = {f["name"] for v in (*kept, version) for f in table.read(v)["folders"]}
        for old in gone:
            for name in {f["name"] for f in table.read(old)["folders"]} - live:
                table.delete(name)
            table.delete(f"manifest/{old}")


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, str, int], None],
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query whose micro-batches are handled with the query's id, which lasts as long as its checkpoint."""

    def with_query(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), batch_id)

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or POLL))
        .foreachBatch(with_query)
        .start()
    )


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All micro-batches as one table, with the column ``batch``."""
    return Batches(spark, path, schema).read()
