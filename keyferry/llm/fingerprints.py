"""Document fingerprints by content-defined chunking: gear-hash boundaries, chunk digests weighted by length."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from keyferry.llm.common import hashes_at, prefix_sums, shuffle_partitions, slices, utf8_of, whole_text

#: Bytes of a chunk: no boundary before LEAST, a rarer kind of boundary up to NORMAL, a more frequent one up to MOST.
LEAST, NORMAL, MOST = 16, 32, 128
WINDOW = 16  # bytes that decide on a boundary; not above LEAST, so that a text alone decides on its chunks
RARE_BITS, FREQUENT_BITS = 7, 4
RUN_BYTES = 1 << 20
RANGES = 4  # ranges of ids for each shuffle partition
DIGEST_BYTES = 6
_GEAR = np.random.default_rng(977).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of consecutive texts, and the number of chunks of each text."""
    gear = _GEAR[data]
    width = 1
    while width < WINDOW:
        gear[width:] += gear[:-width].copy() << np.uint32(width)
        width *= 2
    # the upper bits depend on the whole window
    high = gear >> np.uint32(WINDOW - 1 - RARE_BITS)
    rare = (np.flatnonzero((high & np.uint32((1 << RARE_BITS) - 1)) == 0) + 1).tolist()
    frequent = (np.flatnonzero((high & np.uint32((1 << FREQUENT_BITS) - 1)) == 0) + 1).tolist()
    ends, counts = [], []
    r = f = 0
    nr, nf = len(rare), len(frequent)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        before = len(ends)
        while start < stop:
            if stop - start <= LEAST:
                start = stop
            else:
                r = bisect_left(rare, start + LEAST, r)
                if r < nr and rare[r] < start + NORMAL and rare[r] < stop:
                    start = rare[r]
                else:
                    f = bisect_left(frequent, start + NORMAL, f)
                    last = min(start + MOST, stop)
                    start = frequent[f] if f < nf and frequent[f] < last else last
            ends.append(start)
        counts.append(len(ends) - before)
    return np.array(ends, dtype=np.int64), np.array(counts, dtype=np.int64)


def fingerprints_of(texts: list[str]) -> list[np.ndarray]:
    """For each text its distinct chunks: sorted digests, in the lowest byte of each the chunk's length."""
    data, offsets = utf8_of(pa.array(texts, pa.large_string()))
    found: list[np.ndarray] = []
    for a, b in slices(offsets, RUN_BYTES):
        part = data[offsets[a] : offsets[b]]
        ends, counts = boundaries(part, offsets[a : b + 1] - offsets[a])
        starts = np.zeros_like(ends)
        starts[1:] = ends[:-1]
        digests = hashes_at(prefix_sums(part), starts, ends) >> np.uint64(64 - 8 * DIGEST_BYTES)
        chunks = digests << np.uint64(8) | (ends - starts).astype(np.uint64)
        found += [np.unique(c) for c in np.split(chunks, np.cumsum(counts)[:-1])]
    return found


def written(fingerprint: np.ndarray) -> str:
    """Seven bytes a chunk in hexadecimal: digest, then length."""
    return fingerprint.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of ``a``'s distinct chunks, weighted by length, that ``b`` holds; two empty texts are alike."""
    if not len(a):
        return float(not len(b))
    lengths = a & np.uint64(255)
    return float(lengths[np.isin(a, b, assume_unique=True)].sum() / lengths.sum())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of the following one, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compared(ids: list, texts: list[str], nexts: list[str], known: list[np.ndarray], next_known: list) -> pa.RecordBatch:
    """Result rows of texts with their following ones and both fingerprints."""
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    prints = fingerprints_of(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array(map(written, known), pa.string()),
            pa.array(map(written, prints), pa.string()),
            pa.array(map(containment, known, prints), pa.float64()),
            pa.array(map(containment, known, next_known), pa.float64()),
        ],
        names=[f.split()[0] for f in RESULT.split(", ")],
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Ids and texts of consecutive rows of one range; a range may come in several pieces."""
    for batch in batches:
        parts = batch.column("part").to_numpy()
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield int(parts[a]), ids[a:b], texts[a:b]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of the sorted ranges but the last of each, whose following row lies in another."""
    at, id_, text, prints = None, None, None, None
    for part, ids, texts in _by_range(batches):
        found = fingerprints_of(texts)
        if part == at:
            ids, texts, found = [id_, *ids], [text, *texts], [prints, *found]
        if len(ids) > 1:
            yield compared(ids[:-1], texts[:-1], texts[1:], found[:-1], found[1:])
        at, id_, text, prints = part, ids[-1], texts[-1], found[-1]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range: its place, the first text, and the last id and text."""
    kind = pa.schema([("part", pa.int32()), ("first_text", pa.string()), ("doc_id", pa.int64()), ("text", pa.string())])
    at, first, last = None, None, None
    for part, ids, texts in _by_range(batches):
        if part != at:
            if at is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (at, first, *last)))], schema=kind)
            at, first = part, texts[0]
        last = ids[-1], texts[-1]
    if at is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (at, first, *last)))], schema=kind)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, nexts = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
        if ids:
            yield compared(ids, texts, nexts, fingerprints_of(texts), fingerprints_of(nexts))


def fingerprint_column(text: str | Column = "text") -> Column:
    """The fingerprint of a text column, as text; null counts as empty."""

    @F.arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(map(written, fingerprints_of([t.as_py() or "" for t in texts])), pa.string())

    return fingerprint(text)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how much of the first the others hold.

    Documents follow each other by falling ``doc_id``, then text; a null id comes last; the first follows the last. A
    null text counts as empty; the fingerprint of an empty text is empty. A single row follows itself. Other columns
    are not carried; one row per row of ``docs``.

    Texts are shuffled once, into ranges of ids between quantiles. Within a range a row's follower is the next one in
    order; the text at the end of each range meets the first of the next in a window over one row per range.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    shares = [i / (RANGES * n) for i in range(1, RANGES * n)]
    cuts = np.unique(np.array(rows.approxQuantile("doc_id", shares, 0.25 / (RANGES * n)) or [], dtype=np.float64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        falling = len(cuts) - np.searchsorted(cuts, values.astype(np.float64), side="right")
        return pa.array(np.where(known, falling, len(cuts) + 1).astype(np.int32))

    order = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text"))
    ranged = rows.withColumn("part", part_of("doc_id")).repartition(n, "part").sortWithinPartitions("part", *order)
    inside = ranged.mapInArrow(_neighbours, RESULT)
    edges = ranged.mapInArrow(_edges, "part int, first_text string, doc_id long, text string")
    by_part = W.orderBy("part")
    following = F.coalesce(
        F.lead("first_text").over(by_part),
        F.first("first_text").over(by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    )
    at_edges = edges.select("doc_id", "text", following.alias("next_text")).mapInArrow(_at_edges, RESULT)
    return inside.unionByName(at_edges)
