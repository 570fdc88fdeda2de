"""Exact top-k by inner product with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PIVOTS = 32
#: Pivots come from at most so many vectors, the first by a hash of their id.
PIVOT_SAMPLE = 512
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Each query block meets the rows in so many shares, one task each.
SHARES = 16


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` with components floor(64 * x); rows with a null or non-finite component are out."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * 64.0).cast("double"))
    return vectors.where(x.isNotNull() & F.col(vec_id).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("vector")
    )


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Far-apart vectors of a bounded sample, each the one farthest from those before it."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    held = _padded([r.vector for r in rows], max(len(r.vector) for r in rows))
    found = [int(np.argmax(np.linalg.norm(held, axis=1)))]
    nearest = np.linalg.norm(held - held[found[0]], axis=1)
    while len(found) < min(pivots, len(held)) and nearest.max() > 0:
        found.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, np.linalg.norm(held - held[found[-1]], axis=1))
    return held[found]


def _padded(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _blocks(rows: int):
    """Pack the vectors of each group into blocks of at most ``rows``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(group: int, ids: list, vectors: list) -> dict:
            dims = max(map(len, vectors))
            return {
                "group": group,
                "ids": np.array(ids, dtype=np.int64).tobytes(),
                "vectors": _padded(vectors, dims).astype(np.float64).tobytes(),
                "dims": dims,
                "n": len(ids),
            }

        for batch in batches:
            out = []
            for group, i, v in zip(*(batch.column(c).to_pylist() for c in ("group", "vec_id", "vector"))):
                ids, vectors = held.setdefault(group, ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    out.append(block(group, *held.pop(group)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([block(g, *held[g]) for g in sorted(held)], schema=schema)

    schema = pa.schema(
        [("group", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("dims", pa.int32()), ("n", pa.int32())]
    )
    return pack


class _Best:
    """The best ``k`` scores of each query so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in the scores (a row for each of some queries) of rows with these ids."""
        reach = self.scores[queries, -1]
        if scores.shape[1] > self.k:
            # no more than k of them, and ties with the last, can stay
            reach = np.maximum(reach, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, column = np.nonzero((scores >= reach[:, None]) & (scores > -np.inf))
        some = np.unique(at)
        if not len(some):
            return
        touched = queries[some]
        query = np.concatenate([np.repeat(touched, self.k), queries[at]])
        score = np.concatenate([self.scores[touched].ravel(), scores[at, column]])
        found = np.concatenate([self.found[touched].ravel(), ids[column]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        first = np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = np.arange(len(query)) - first < self.k
        self.scores[touched] = score[keep].reshape(-1, self.k)
        self.found[touched] = found[keep].reshape(-1, self.k)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _search(best: _Best, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray) -> int:
    """Bring a block of rows to its queries; returns for how many pairs the inner product was taken.

    The rows are grouped by their nearest pivot. The table of distances to the pivots gives for every group the smallest
    and largest distance to each pivot, and with these, for every query, the largest of the lower bounds of its distance
    to any row of the group; so also an upper bound of the inner products: ``(|q|^2 + |x|^2 - d^2) / 2``. Groups are
    evaluated by falling bound, each by one matrix product, for the queries whose k-th score is not above the bound. A bound
    that equals it may still hide a tie and is evaluated.
    """
    dims = max(rows.shape[1], best.vectors.shape[1], pivots.shape[1])
    widen = lambda a: np.pad(a, ((0, 0), (0, dims - a.shape[1]))) if a.shape[1] < dims else a
    rows, queries, pivots = widen(rows), widen(best.vectors), widen(pivots)
    row_norms, query_norms = (rows * rows).sum(1), (queries * queries).sum(1)
    to_rows, to_queries = _distances(rows, pivots), _distances(queries, pivots)
    nearest = to_rows.argmin(1) if len(pivots) else np.zeros(len(rows), np.int64)
    order = np.argsort(nearest, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(nearest[order]) != 0)), len(rows))
    groups = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    bounds = np.empty((len(groups), len(queries)))
    for g, members in enumerate(groups):
        least, most = to_rows[members].min(0), to_rows[members].max(0)
        apart = np.maximum(to_queries - most, least - to_queries).max(1, initial=0.0)
        norm = row_norms[members].max()
        # what rounding may take from a distance between vectors of these lengths
        slack = 1e-6 * np.sqrt(1 + query_norms + norm)
        bound = (query_norms + norm - np.maximum(apart - slack, 0.0) ** 2) / 2 + slack
        # no score exceeds the product of the lengths either
        bounds[g] = np.minimum(bound, np.sqrt(query_norms * norm) + 1e-3)
    evaluated = 0
    for g in np.argsort(-bounds.mean(1), kind="stable").tolist():
        alive = np.flatnonzero(bounds[g] >= best.scores[:, -1])
        if not len(alive):
            continue
        members = groups[g]
        scores = queries[alive] @ rows[members].T
        scores[ids[members] == best.ids[alive][:, None]] = -np.inf
        best.add(alive, scores, ids[members])
        evaluated += scores.size
    return evaluated


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    pivots: int = PIVOTS,
    query_block: int = QUERY_BLOCK,
    shares: int = SHARES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` rows of ``vectors`` with the highest inner products.

    Both tables hold ``vec_id`` and ``vector``, see ``whole_vectors``. Ties go to the smaller id; rows with the query's
    own id are no candidates; a query with fewer candidates gets them all. Vectors of unequal length are compared as if
    filled up with zeros. Repeated rows are candidates each; a repeated query is answered once. Empty tables give no rows.

    Queries lie in blocks, and every block of rows is sent to every query block. The rows of a query block are dealt
    out to ``shares`` tasks, each of which holds the query block and one block of rows at a time and carries its best
    scores along; the shares' results are merged by a window over at most ``k * shares`` rows a query.
    """
    table = choose_pivots(vectors, pivots)
    queries = queries.dropDuplicates(["vec_id"])
    blocks = max(1, -(-queries.count() // query_block))
    packed = "group int, ids binary, vectors binary, dims int, n int"
    of_queries = (
        queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("group"), "vec_id", "vector")
        .repartition(blocks, "group")
        .mapInArrow(_blocks(query_block), packed)
        .select(F.col("group").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "ids", "vectors", "dims", "n")
    )
    of_rows = (
        vectors.select(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(shares)).cast("int").alias("group"), "vec_id", "vector")
        .mapInArrow(_blocks(ROW_BLOCK), packed)
        .select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), F.col("group").alias("share"), F.lit(1).alias("kind"), "ids", "vectors", "dims", "n")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def results() -> Iterator[pa.RecordBatch]:
            for best in held:
                n, width = best.scores.shape
                there = best.scores.ravel() > -np.inf
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(best.ids, width)[there]),
                        pa.array(best.found.ravel()[there]),
                        pa.array(best.scores.ravel()[there].astype(np.int64)),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                held_vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
                if (row["qb"], row["share"]) != at:
                    yield from results()
                    at, held = (row["qb"], row["share"]), []
                if row["kind"] == 0:
                    held.append(_Best(ids, held_vectors, k))
                else:
                    for best in held:
                        _search(best, ids, held_vectors, table)
        yield from results()

    met = of_queries.unionByName(of_rows).repartition(blocks * shares, "qb", "share")
    found = met.sortWithinPartitions("qb", "share", "kind").mapInArrow(
        search, "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
