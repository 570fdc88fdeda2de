"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import whole_text

SIZES = (3, 4, 5)
BUCKET_BITS = 20
#: Bound of the training sample: so many labelled rows of each class at most, chosen by a hash of their id.
SAMPLE_OF_CLASS = 2500
#: A feature counts if so many training texts hold it and its shares in the classes differ by so many standard errors.
LEAST_TEXTS, LEAST_ERRORS = 4, 5.0
SMOOTHING, PENALTY, STEPS, RATE = 1.0, 0.3, 150, 0.05
THRESHOLD = 0.7
CHUNK_CHARS = 1 << 18
_GAP = "\0" * (max(SIZES) - 1)
_MULTIPLIER = np.uint32(0x9E3779B1)


def features_in(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of whole texts: the first row, and of each n-gram the row in the run and the feature, repeats included."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK_CHARS):
            size += len(texts[end])
            end += 1
        run = texts[start:end]
        # marks between texts: n-grams at a text's ends differ from those inside, none holds parts of two texts
        joined = _GAP + _GAP.join(run) + _GAP
        codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t.lower()) + len(_GAP) for t in run])
        row_of = np.repeat(np.arange(len(run), dtype=np.int32), sizes)
        rows, found = [], []
        value = codes
        for n in range(2, max(SIZES) + 1):
            value = value[:-1] * _MULTIPLIER + codes[n - 1 :]
            if n in SIZES:
                mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                feature = (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
                keep = min(len(feature), len(row_of))
                rows.append(row_of[:keep])
                found.append(feature[:keep])
        yield start, np.concatenate(rows), np.concatenate(found)
        start = end


@dataclass(frozen=True)
class Model:
    """One weight for each feature, already scaled by its ratio, and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; a feature counts once however often a text holds it."""
        margins = np.full(len(texts), self.intercept)
        for start, rows, features in features_in(texts):
            weighty = np.flatnonzero(self.weights[features])
            pairs = np.unique(rows[weighty].astype(np.int64) << BUCKET_BITS | features[weighty])
            sums = np.bincount(pairs >> BUCKET_BITS, self.weights[pairs & ((1 << BUCKET_BITS) - 1)])
            margins[start : start + len(sums)] += sums
        return 1.0 / (1.0 + np.exp(-np.clip(margins, -50, 50)))


def _pairs_in(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of whole texts the rows and their distinct features."""
    for start, rows, features in features_in(texts):
        pairs = np.unique(rows.astype(np.int64) << BUCKET_BITS | features)
        yield (pairs >> BUCKET_BITS).astype(np.int32) + start, (pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32)


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fit the classifier: ratios from the texts' features, then logistic regression with a penalty on the scaled ones."""
    size = 1 << BUCKET_BITS
    labels = np.asarray(labels, dtype=np.float64)
    ones = float(labels.sum())
    if not 0 < ones < len(labels):
        # one class only: nothing to tell apart
        return Model(np.zeros(size, np.float32), -4.0 if not ones else 4.0)
    with_one, with_zero = np.zeros(size), np.zeros(size)
    for row, feature in _pairs_in(texts):
        one = (labels == 1)[row]
        with_one += np.bincount(feature[one], minlength=size)
        with_zero += np.bincount(feature[~one], minlength=size)
    ratio = np.log((with_one + SMOOTHING) / (ones + 2 * SMOOTHING)) - np.log(
        (with_zero + SMOOTHING) / (len(labels) - ones + 2 * SMOOTHING)
    )
    share = (with_one + with_zero) / len(labels)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / (len(labels) - ones)))
    apart = np.abs(with_one / ones - with_zero / (len(labels) - ones)) / error
    ratio[(with_one + with_zero < LEAST_TEXTS) | (apart < LEAST_ERRORS)] = 0
    # the texts are read again, since few of their features count: all of them at once would be many times as large
    rows, found = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for row, feature in _pairs_in(texts):
        kept = ratio[feature] != 0
        rows.append(row[kept])
        found.append(feature[kept])
    row, feature = np.concatenate(rows), np.concatenate(found)
    # both classes weigh alike while the weights are sought
    share = np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones))
    scaled = ratio[feature]
    weights, intercept = np.zeros(size), 0.0
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        margins = np.bincount(row, weights[feature] * scaled, minlength=len(labels)) + intercept
        error = share * (1 / (1 + np.exp(-np.clip(margins, -50, 50))) - labels)
        slope = np.append(
            np.bincount(feature, error[row] * scaled, minlength=size) + PENALTY / len(labels) * weights, error.sum()
        )
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        move = RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        intercept -= move[-1]
    return Model((weights * ratio).astype(np.float32), float(intercept))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 modulo 3. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, of_class: int = SAMPLE_OF_CLASS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``of_class`` labelled rows of each class that are not held out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    chosen = [known.where(F.col("toxic") == c).orderBy("place", "doc_id").limit(of_class) for c in (0, 1)]
    # at most 2 * of_class short rows, so the broadcast has a bound
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")
    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, of_class: int = SAMPLE_OF_CLASS) -> Model:
    """Train on a bounded sample in one task; only the weights reach the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (i, x, t)
            for b in batches
            for i, x, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")))
        )
        model = train([x for _, x, _ in rows], np.array([t for _, _, t in rows]))
        held = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict(
            {
                "features": [held.astype(np.int32).tobytes()],
                "weights": [model.weights[held].tobytes()],
                "intercept": [model.intercept],
            }
        )

    sample = training_sample(docs, labels, of_class)
    # a shuffle of the few sampled rows; coalesce would read the whole table in one task
    row = sample.repartition(1).mapInArrow(learn, "features binary, weights binary, intercept double").first()
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if row is None:
        return Model(weights, -4.0)
    weights[np.frombuffer(row.features, np.int32)] = np.frombuffer(row.weights, np.float32)
    return Model(weights, row.intercept)


def score_column(text: str | Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores([t.as_py() or "" for t in texts]), pa.float64())

    return score(text)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each whole text, one row per row of ``docs``.

    Only the text is scored. A null text counts as empty and gets the score of a text without features. Without any
    usable label the model gives every text a low score. Other columns are not carried. No shuffle.
    """
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(whole_text(), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
