"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over block quotas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keyferry.llm.common import checkpointed, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents fall into so many blocks, and each block into so many parts, by a hash of id and text.
BLOCKS, PARTS = 1024, 1024
SHARDS = 64
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(source: str | Column = "source") -> Column:
    """A text for every source, null included, for joins by equality."""
    column = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))


def place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), whole_text())


def block_of(at: Column) -> Column:
    return F.pmod(at, F.lit(BLOCKS)).cast("int")


def part_of(at: Column) -> Column:
    return F.pmod(F.shiftright(at, 20), F.lit(PARTS)).cast("int")


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id``, ``source``, ``key``, ``size``, ``block`` and ``part`` of every document, in short rows."""
    source = F.col("source").cast("string")
    return docs.select(
        "doc_id",
        source.alias("source"),
        source_key(source).alias("key"),
        word_count(whole_text()).alias("size"),
        block_of(place(seed)).alias("block"),
        part_of(place(seed)).alias("part"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """``key``, ``source_size`` and ``target`` of each source.

    Weights 1, 2, 3 repeat over the sources by code point, null last. A target stops at ``MOST_TIMES`` its source's
    size and the excess goes to the others by weight. With sources ordered by cap / weight, those before the first
    one that its share doesn't fill are capped. The windows hold one row per source.
    """
    totals = sized.groupBy("key").agg(
        F.first("source").alias("source"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")
    )
    everything = W.partitionBy()
    ranked = totals.select(
        "*",
        F.get(
            F.array(*map(F.lit, WEIGHTS)),
            F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))),
        ).alias("weight"),
    ).select(
        "*",
        (F.col("source_size") * float(MOST_TIMES)).alias("cap"),
        (F.col("source_size") * float(MOST_TIMES) / F.col("weight")).alias("filled_at"),
    )
    by_fill = W.orderBy("filled_at", "key")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.select(
        "*", (rest / rest_weight).alias("level"), F.row_number().over(by_fill).alias("n")
    )
    first = F.min(
        F.when(F.col("filled_at") >= F.col("level"), F.struct("n", "level"))
    ).over(everything)["level"]
    return levels.select(
        "key", "source_size", F.least("cap", F.coalesce(first, F.lit(0.0)) * F.col("weight")).alias("target")
    )


def filled(words: np.ndarray, room: float) -> tuple[np.ndarray, float]:
    """Which pieces are taken if each is that still fits, in order, and the room that is left."""
    taken = np.zeros(len(words), dtype=bool)
    for n, size in enumerate(words.tolist()):
        if size <= room:
            taken[n] = True
            room -= size
    return taken, room


def draws(sized: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """How often each block is drawn: ``key``, ``block``, ``times``, and ``parts``, those of it drawn once more.

    A source is taken whole as often as its target holds its size. The rest comes from its blocks in an order permuted
    by a hash, each if it still fits. What then is missing comes from the parts of its smallest block left, in the
    same way, with one part more if that comes nearer. A group holds one row per block of a source, or part of a block.
    """

    def fill_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "block"], ignore_index=True)
        target, size = float(frame["target"].iloc[0]), int(frame["words"].sum())
        whole = min(int(target // size), MOST_TIMES) if size else 0
        taken, room = filled(frame["words"].to_numpy(), target - whole * size)
        rooms = np.zeros(len(frame))
        rest = np.flatnonzero(~taken & (frame["words"].to_numpy() > 0))
        if len(rest) and whole < MOST_TIMES:
            rooms[rest[np.argmin(frame["words"].to_numpy()[rest])]] = room
        return frame[["key", "block"]].assign(times=whole + (taken & (whole < MOST_TIMES)), room=rooms)

    def fill_parts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "part"], ignore_index=True)
        words = frame["words"].to_numpy()
        taken, room = filled(words, float(frame["room"].iloc[0]))
        rest = np.flatnonzero(~taken)
        if len(rest) and words[rest].min() < 2 * room:
            taken[rest[np.argmin(words[rest])]] = True
        return frame.loc[taken, ["key", "block", "part"]]

    blocks = (
        sized.groupBy("key", "block")
        .agg(F.sum("size").alias("words"))
        .join(wanted.select("key", "target"), "key")
        .withColumn("at", F.xxhash64(F.lit(seed + 1), "key", "block"))
        .groupBy("key")
        .applyInPandas(fill_blocks, "key string, block int, times int, room double")
    )
    blocks = checkpointed(blocks)
    parts = (
        sized.join(blocks.where("room > 0").select("key", "block", "room"), ["key", "block"])
        .groupBy("key", "block", "part")
        .agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        .withColumn("at", F.xxhash64(F.lit(seed + 2), "key", "part"))
        .groupBy("key", "block")
        .applyInPandas(fill_parts, "key string, block int, part int")
        .groupBy("key", "block")
        .agg(F.collect_set("part").alias("parts"))
    )
    return blocks.select("key", "block", "times").join(parts, ["key", "block"], "left")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal ``quota`` blocks of each ``key`` out to the shards: ``key``, ``shard``, ``quota``, exact in every sum.

    A binary tree over the shards: at each node the left half's blocks are a multivariate-hypergeometric draw from the
    node's quotas. All nodes of a level are drawn side by side, each from its own seed; a node holds one row per source.
    """
    nodes = quotas.select("key", "quota", F.lit(0).alias("low"), F.lit(shards).alias("high"))

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        if high - low == 1:
            return frame
        middle = (low + high) // 2
        colors = frame["quota"].to_numpy(dtype=np.int64)
        # shards get as many blocks as each other, give or take one
        here = int(colors.sum())
        size = here * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(colors, size, method="marginals")
        return pd.concat(
            [
                frame.assign(quota=left, high=middle),
                frame.assign(quota=colors - left, low=middle),
            ]
        )

    for _ in range(max(0, shards - 1).bit_length()):
        nodes = nodes.groupBy("low", "high").applyInPandas(split, "key string, quota long, low int, high int")
    return nodes.select("key", F.col("low").alias("shard"), "quota")


def assign(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """``key``, ``block``, ``parts`` and ``copies``: pass and shard of every time a block is drawn.

    Each source's drawn blocks stand in a permuted order, and the shards take disjoint runs of it, as long as their
    quotas. A block drawn in part is its last pass.
    """
    passes = F.col("times") + F.when(F.col("parts").isNotNull(), 1).otherwise(0)
    items = drawn.where(passes > 0).select("key", "block", F.explode(F.sequence(F.lit(1), passes)).alias("pass"))
    order = W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 3), "key", "block", "pass"), "block", "pass")
    items = items.withColumn("n", F.row_number().over(order))
    dealt = split_quotas(items.groupBy("key").agg(F.count("*").alias("quota")), shards, seed)
    upto = F.sum("quota").over(W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    places = (
        dealt.withColumn("upto", upto)
        .where("quota > 0")
        .select("key", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("n"))
    )
    copies = (
        items.join(places.withColumn("n", F.col("n").cast("int")), ["key", "n"])
        .groupBy("key", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("copies"))
    )
    return drawn.select("key", "block", "times", "parts").join(copies, ["key", "block"])


def plan_mix(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sizes, the sources' targets, and the drawn blocks with their shards; all are short tables."""
    sized = checkpointed(sizes(docs, seed))
    wanted = checkpointed(targets(sized))
    return sized, wanted, assign(checkpointed(draws(sized, wanted, seed)), shards, seed)


def copies_of(block: Column, part: Column) -> Column:
    """The copies of a document: those of its block, without the last pass if only other parts were drawn in it."""
    return F.coalesce(
        F.filter(
            F.col("copies"),
            lambda c: (c["pass"] <= F.col("times")) | F.coalesce(F.array_contains("parts", part), F.lit(False)),
        ),
        F.array().cast("array<struct<pass:int,shard:int>>"),
    )


def mix_counts(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``copies`` (pass and shard), one row per row of ``docs``.

    A null or empty text has size 0; a null source is a source of its own, the last. Repeated rows fall into the same
    part and are drawn alike. Without any word all targets are 0 and nothing is drawn. The draw depends on ids, texts,
    sources and the seed only, so reruns agree. Other columns are not carried.
    """
    sized, wanted, assigned = plan_mix(docs, shards, seed)
    return (
        sized.join(wanted, "key", "left")
        .join(assigned, ["key", "block"], "left")
        .select("doc_id", "size", "source_size", "target", copies_of(F.col("block"), F.col("part")).alias("copies"))
    )


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """The mixture: the columns of ``docs``, a row for each copy drawn, shard by shard in shuffled order."""
    _, _, assigned = plan_mix(docs, shards, seed)
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "doc_id", "text", "source")
    placed = inner.select(
        "row",
        source_key().alias("key"),
        block_of(place(seed)).alias("block"),
        part_of(place(seed)).alias("part"),
        place(seed).alias("at"),
    )
    copied = placed.join(assigned, ["key", "block"]).select(
        "row", "at", F.explode(copies_of(F.col("block"), F.col("part"))).alias("copy")
    )
    shuffled = copied.repartition(shards, "copy.shard").sortWithinPartitions(
        "copy.shard", F.xxhash64(F.lit(seed + 4), "at", "copy.pass")
    )
    return shuffled.select("row.*")
