"""Connected components of links by alternating stars; hubs are folded by aggregates, never collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import checkpointed, tasks_for


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least one: all larger neighbours of a node, or a node and its smaller neighbours.

    Repeated edges give repeated edges, never more of them than two for one.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return hung.where("u <> v")


def connected(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the least id that links reach, of every id in ``links`` (``a``, ``b``).

    Repeated links, links to oneself and both directions are harmless; no links give no rows. Every task of a shuffle
    writes files of its own, so few edges are kept in few tasks.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, rows = None, edges.count()
    while True:
        tasks = tasks_for(rows)
        large = _star(edges.coalesce(tasks), large=True).coalesce(tasks)
        edges = checkpointed(_star(large, large=False).coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        state, rows = now, now[0]
