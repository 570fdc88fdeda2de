"""Whitening of embeddings by their leading principal components.

Counts, sums and the centred covariance come from partial results of the tasks; only one row per pair of dimensions
reaches the driver, whatever the number of vectors. There the eigenpairs are found (``eigen``), and the projection is
broadcast to the rows.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyferry.llm.eigen import leading_pairs

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries are held to this size, so that sums of a batch fit 64 bits.
MOST = 2.0**48
#: Components with less than this share of the first one's eigenvalue cannot be told from rounding.
LEAST_SHARE = 1e-11
#: Values worked on at a time.
STEP = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """What was fitted: number of vectors, exact sums, means, and the unit components (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``c``, the entries as doubles; rows with a null vector, a null or a non-finite entry are out."""
    c = F.col(vector).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(c.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c"))


def _fixed(batch: pa.RecordBatch, width: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ranges of a batch: first row, lengths, and the vectors as integers, each filled up to the width with zeros."""
    column = batch.column("c")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    ends = np.cumsum(lengths)
    step = max(1, STEP // max(width, 1))
    for start in range(0, len(lengths), step):
        some = lengths[start : start + step]
        c = np.zeros((len(some), width))
        first = ends[start] - lengths[start]
        c[np.arange(width) < some[:, None]] = entries[first : first + some.sum()]
        yield start, some, np.clip(np.floor(c * SCALE) + SHIFT, -MOST, MOST).astype(np.int64)


def column_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension, over the integers floor(1024 * c) + 100000."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, sums = 0, [], []
        for batch in batches:
            for _, lengths, x in _fixed(batch):
                rows += len(x)
                more = x.shape[1] - len(sums)
                held += [0] * more
                sums += [0] * more
                there = np.arange(x.shape[1]) < lengths[:, None]
                for j, (n, s) in enumerate(zip(there.sum(0).tolist(), np.where(there, x, 0).sum(0).tolist())):
                    held[j] += n
                    sums[j] += s
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *range(len(sums))], pa.int32()),
                pa.array([rows, *held], pa.int64()),
                pa.array([Decimal(0), *map(Decimal, sums)], pa.decimal128(38, 0)),
            ],
            names=["j", "held", "total"],
        )

    parts = vectors.mapInArrow(partial, "j int, held long, total decimal(38,0)")
    found = parts.groupBy("j").agg(F.sum("held").alias("held"), F.sum("total").alias("total")).collect()
    at = {r.j: (int(r.held), int(r.total)) for r in found}
    n = at.pop(-1, (0, 0))[0]
    # a dimension that a vector lacks counts as an entry of 0
    return n, [at[j][1] + (n - at[j][0]) * SHIFT for j in range(len(at))]


def _second_moments(vectors: DataFrame, width: int, size: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of the outer products of ``centred`` rows, in a last row and column also their sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            for _, _, x in _fixed(batch, width):
                y = np.column_stack([centred(x), np.ones(len(x))])
                total += y.T @ y
        i, j = np.triu_indices(size + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
        )

    parts = vectors.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((size + 1, size + 1))
    i, j, v = (parts[c].to_numpy() for c in ("i", "j", "v"))
    total[i, j] = total[j, i] = v
    return total


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``vectors`` (see ``whole_vectors``); None without vectors.

    The covariance has divisor n and is centred before multiplying. Directions without variance are no components.
    """
    n, sums = column_sums(vectors)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    width = len(sums)
    covariance = _second_moments(vectors, width, width, lambda x: x - mean)[:width, :width] / n
    values, found = leading_pairs(covariance, components)
    kept = values > values.max(initial=0.0) * LEAST_SHARE
    return Whitening(n, sums, found[:, kept], values[kept], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, measured over all of them."""
    size = len(model.values)
    total = _second_moments(vectors, len(model.sums), size, model.whitened)
    means = total[:size, size] / model.n
    covariance = total[:size, :size] / model.n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(size)).max(initial=0.0))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2 for each row, exact; None where it exceeds 64 bits."""
    mean = np.array([s / n for s in sums])
    about = (((x - mean) * n) ** 2).sum(1)
    # sums beyond 64 bits wrap, and so does n*x; the difference is right wherever it fits
    wrapped = np.array([s % (1 << 64) for s in sums], dtype=np.uint64)
    d = (x.astype(np.uint64) * np.uint64(n) - wrapped).astype(np.int64)
    found: list[int | None] = (d * d).sum(1).tolist()
    for i in np.flatnonzero(about >= 2.0**62):
        exact = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums))
        found[i] = exact if exact < 1 << 63 else None
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    ``vectors`` are as ``whole_vectors`` gives them. Repeated rows and rows without an id count and are returned like
    others. Vectors of unequal length are compared as if filled up with entries of 0, and entries beyond 2**38 count as
    that. Without vectors, or if all are alike, there are no components and no rows. ``deviation`` is null where it
    exceeds a long.
    """
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    spark = vectors.sparkSession
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error = identity_error(vectors, model)
    held = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        size = len(model.values)
        explained = model.values / model.trace
        for batch in batches:
            for start, _, x in _fixed(batch, len(model.sums)):
                m = len(x)
                rows = np.repeat(np.arange(m), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(start, m).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * size, model.n)),
                        pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(rows)),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * size, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(project, schema)
