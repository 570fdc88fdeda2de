"""N-gram Jaccard join by PartEnum signatures, as exact components of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyferry.llm.common import (
    checkpointed,
    gathered,
    hashes_at,
    mixed,
    prefix_sums,
    shuffle_partitions,
    slices,
    utf8_of,
    whole_text,
)
from keyferry.llm.components import connected
from keyferry.session import stored

WORDS = 5
#: Two sets link when NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 80, 100
#: A band of set sizes ends at so many times its start.
BAND_RATIO = 1.4
#: Up to this distance, partitions are cut in three and each pair of thirds gives a signature; beyond, a whole one does.
THIRDS_UPTO = 64
#: So many times the partitions that are needed; the spare ones let a set leave out those that hold few of its elements.
SPARE = 1.15
RUN_BYTES = 1 << 20
#: A larger group of sets with one signature is compared in so large pieces, each pair of pieces in a task.
PIECE = 4096
#: The same for the sets of a component, all pairs of which are counted.
LINK_PIECE = 2048
#: Elements that several sets of a component hold are counted so many at a time.
COLUMNS = 1024
#: Signatures a task holds before it sends them on.
HELD_SIGNATURES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """For runs of rows, each row's sorted distinct 64-bit hashes of five consecutive words; all its words if fewer."""
    data, offsets = utf8_of(texts)
    for a, b in slices(offsets, RUN_BYTES):
        part = _LOWER[data[offsets[a] : offsets[b]]]
        starts_of = offsets[a : b + 1] - offsets[a]
        yield _sets(part, starts_of)


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    rows = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * rows
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = word[heads]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] = word[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    hashes = hashes_at(prefix_sums(data), starts, ends)
    first = np.searchsorted(starts, offsets)
    n = len(hashes)
    found: list[np.ndarray] = []
    if n >= WORDS:
        joined = hashes[: n - WORDS + 1].copy()
        for i in range(1, WORDS):
            joined = joined * _STEP + hashes[i : n - WORDS + 1 + i]
        joined = mixed(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            found.append(np.unique(joined[a : b - WORDS + 1]))
        elif b > a:
            value = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                value = value * _STEP + h
            found.append(mixed(value + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def set_id(elements: np.ndarray) -> int:
    """A 64-bit name of a set, alike for equal sets."""
    parts = mixed(np.append(elements, np.uint64(len(elements))) ^ np.uint64(0x5851F42D4C957F2D))
    return int(mixed(parts.sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def set_sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements in a power of two of cells, one for an element or more.

    Two sets differ in at least as many elements as cells. A sketch is folded to half its cells by joining its halves.
    """
    words = 1 << max(0, (len(elements) - 1) >> 6).bit_length()
    cells = mixed(elements + np.uint64(99)) & np.uint64(words * 64 - 1)
    odd = np.bincount(cells.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def linked(shared: int, a: int, b: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def least_partner(size: int) -> int:
    """The smallest set that a set of this size can link with."""
    return -(-NUMERATOR * size // DENOMINATOR)


def distance_bound(largest: int) -> int:
    """In how many elements two linked sets of at most this size can differ."""
    return (DENOMINATOR - NUMERATOR) * 2 * largest // (DENOMINATOR + NUMERATOR)


def bands(size: int) -> list[tuple[int, int]]:
    """(number, largest size) of the bands a set takes part in: its own, and the next if it can link with a larger set there."""
    number, start = 0, 1
    while True:
        end = int(start * BAND_RATIO)
        if size <= end:
            break
        number, start = number + 1, end + 1
    found = [(number, end)]
    if least_partner(end + 1) <= size:
        found.append((number + 1, int((end + 1) * BAND_RATIO)))
    return found


def signatures(elements: np.ndarray) -> np.ndarray:
    """A set's signatures: any two different sets that link share one.

    Within a band linked sets differ in at most ``k`` elements. The domain is cut into ``n1`` partitions by a hash. If
    each may hide ``k2`` differences, at most ``k // (k2 + 1)`` of them hold more. In every other one the two sets
    agree on all but ``k2`` of its ``n2`` cells, so they share the signature of that subset of cells; all subsets
    are enumerated. Since more partitions agree than one, a set leaves out subsets with fewer elements than its bound:
    the largest for which, whatever partitions disagree, an agreeing one is left. Agreeing subsets hold equally many
    elements in both sets, so what the set with the higher bound keeps the other keeps too.
    """
    out = []
    spread = mixed(elements * _STEP)
    for number, largest in bands(len(elements)):
        k = distance_bound(largest)
        if not k:
            continue  # only equal sets link
        k2 = 1 if k <= THIRDS_UPTO else 0
        n2 = 3 if k2 else 1
        n1 = int(SPARE * (k + 1) / (k2 + 1)) + 1
        cell = (spread % np.uint64(n1)).astype(np.int64) * n2 + ((spread >> np.uint64(40)) % np.uint64(n2)).astype(np.int64)
        counts = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell, spread)
        sums = sums.reshape(n1, n2)
        if k2:
            counts = counts.sum(1, keepdims=True) - counts
            sums = sums.sum(1, keepdims=True, dtype=np.uint64) - sums
        spare = n1 - k // (k2 + 1) - 1
        bound = np.partition(counts.min(1), spare)[spare]
        names = (np.arange(n1 * n2, dtype=np.uint64) + np.uint64((number + 1) << 40)) * np.uint64(0xA0761D6478BD642F)
        keep = (counts >= bound).ravel()
        out.append(mixed(sums.ravel()[keep] * _STEP + mixed(names[keep])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, set size, set name and sketch of each document."""
    for batch in batches:
        row = 0
        for sets in shingle_sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([set_sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "sketch"],
            )
            row += len(sets)


def _sign(parts: int):
    """Signatures of the distinct sets of a task, packed by part; a set's name stands before its signatures' number."""
    schema = pa.schema([("part", pa.int32()), ("packed", pa.binary())])

    def sent(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        nodes = np.repeat(np.array([n for n, _ in held], np.int64), [len(s) for _, s in held])
        values = np.concatenate([s for _, s in held])
        part = (values % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, values, nodes = part[order], values[order], nodes[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for p, a, b in zip(range(parts), cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b:
                first = np.flatnonzero(np.append(True, nodes[a + 1 : b] != nodes[a : b - 1]))
                counts = np.diff(np.append(first, b - a)).astype(np.int64)
                head = np.array([len(first)], np.int64)
                rows.append((p, b"".join(x.tobytes() for x in (head, nodes[a:b][first], counts, values[a:b]))))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for sets in shingle_sets(batch.column("text")):
                for elements in sets:
                    node = set_id(elements) if len(elements) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    found = signatures(elements)
                    if len(found):
                        held.append((node, found))
                        size += len(found)
                if size >= HELD_SIGNATURES:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return sign


def _meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part, the groups of sets that share a signature: the group's name, set, and number of sets."""
    nodes, values = [], []
    for batch in frames:
        for packed in batch.column("packed"):
            raw = np.frombuffer(packed.as_buffer(), np.int64)
            n = int(raw[0])
            nodes.append(np.repeat(raw[1 : n + 1], raw[n + 1 : 2 * n + 1]))
            values.append(raw[2 * n + 1 :].view(np.uint64))
    if not values:
        return
    values, nodes = np.concatenate(values), np.concatenate(nodes)
    order = np.argsort(values, kind="stable")
    values, nodes = values[order], nodes[order]
    near = values[1:] == values[:-1]
    shared = np.append(False, near) | np.append(near, False)
    values, nodes = values[shared], nodes[shared]
    if not len(values):
        return
    order = np.lexsort((nodes, values))
    values, nodes = values[order], nodes[order]
    new = np.append(True, (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1]))
    values, nodes = values[new], nodes[new]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    counts = np.diff(np.append(starts, len(values)))
    # groups of the same sets need to be looked at once, so a group is named by its sets
    names = mixed(np.add.reduceat(mixed(nodes.view(np.uint64)), starts))
    _, first = np.unique(names, return_index=True)
    keep = np.zeros(len(starts), dtype=bool)
    keep[first] = True
    rows = np.repeat(keep & (counts > 1), counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(names, counts)[rows].view(np.int64)),
            pa.array(nodes[rows]),
            pa.array(np.repeat(counts, counts)[rows].astype(np.int64)),
        ],
        names=["signature", "node", "members"],
    )


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width, the smallest among them."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for row, data in zip(out, sketches):
        cells = np.frombuffer(data, np.uint64)
        while len(cells) > width:
            half = len(cells) // 2
            cells = cells[:half] ^ cells[half:]
        row[:] = cells
    return out


def _may_link(sketches: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which others can link with one: neither sizes nor sketches show too many differences."""
    both = sizes[others] + sizes[one]
    apart = np.bitwise_count(sketches[others] ^ sketches[one]).sum(1, dtype=np.int64)
    most = (DENOMINATOR - NUMERATOR) * both // (DENOMINATOR + NUMERATOR)
    return (apart <= most) & (np.abs(sizes[others] - sizes[one]) <= most)


def _group_pairs(nodes: np.ndarray, sizes: np.ndarray, held: list[bytes], component: np.ndarray | None):
    """Candidate pairs among the sets of a group, or of two pieces of one.

    Without components those of the middle set, which has the sketch nearest to most others, with all others; else all
    pairs of sets in different components.
    """
    if component is not None and (component == component[0]).all():
        return
    sketches = _folded(held)
    if component is None:
        middle = 0
        if len(nodes) > 2:
            bits = np.unpackbits(sketches.view(np.uint8), axis=1)
            middle = int(np.argmin((bits != (bits.mean(0) > 0.5)).sum(1)))
        others = np.delete(np.arange(len(nodes)), middle)
        others = others[_may_link(sketches, sizes, middle, others)]
        yield np.minimum(nodes[others], nodes[middle]), np.maximum(nodes[others], nodes[middle])
        return
    by_component = np.argsort(component, kind="stable")
    for n, i in enumerate(by_component[:-1].tolist()):
        others = by_component[n + 1 :]
        others = others[component[others] != component[i]]
        if len(others):
            others = others[_may_link(sketches, sizes, i, others)]
            yield np.minimum(nodes[others], nodes[i]), np.maximum(nodes[others], nodes[i])


def _bucket_pairs(bucket: pa.Table) -> pa.Table:
    """The distinct candidate pairs of all groups that lie in a bucket."""
    keys = [bucket.column(c).to_numpy() for c in ("signature", "low", "high", "node")]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    order, keys = order[new], [k[new] for k in keys]
    starts = np.append(True, np.any([k[1:] != k[:-1] for k in keys[:3]], axis=0))
    cuts = np.append(np.flatnonzero(starts), len(order)).tolist()
    nodes, sizes = keys[3], bucket.column("n_shingles").to_numpy()[order]
    held = bucket.column("sketch").to_pylist()
    component = bucket.column("component").to_numpy()[order] if "component" in bucket.column_names else None
    pairs = [
        pair
        for x, y in zip(cuts, cuts[1:])
        if y - x > 1
        for pair in _group_pairs(
            nodes[x:y],
            sizes[x:y],
            [held[i] for i in order[x:y].tolist()],
            None if component is None else component[x:y],
        )
    ]
    found = np.unique(np.concatenate([np.stack(p, 1) for p in pairs]), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def _linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that link, and the elements that only one of their sets holds."""
    for batch in batches:
        keep, apart = [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            between = np.setxor1d(x, y, assume_unique=True)
            keep.append(linked((len(x) + len(y) - len(between)) // 2, len(x), len(y)))
            apart.append(between.tobytes() if keep[-1] else None)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).filter(keep) for c in ("a", "b")], pa.array(apart, pa.binary()).filter(keep)],
            names=["a", "b", "apart"],
        )


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sets in shingle_sets(batch.column("text")):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "elements"],
            )


def _from_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set the elements that only it or only its component's centre holds."""
    for batch in batches:
        held = [
            np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)
            for x, y in zip(batch.column("elements"), batch.column("centre"))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([d.tobytes() for d in held], pa.binary())], names=["node", "apart"]
        )


def _in_both(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every left and every right array; of an array with itself any number."""
    found = np.zeros((len(left), len(right)), np.float32)
    values, owners = [], []
    for side in (left, right):
        values.append(np.concatenate([np.zeros(0, np.uint64), *side]))
        owners.append(np.repeat(np.arange(len(side)), [len(d) for d in side]))
    if left is right:
        common, times = np.unique(values[0], return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(*values)
    for start in range(0, len(common), COLUMNS):
        some = common[start : start + COLUMNS]
        held = []
        for side, value, owner in zip((left, right), values, owners):
            at = np.minimum(np.searchsorted(some, value), len(some) - 1)
            there = some[at] == value
            cells = np.zeros((len(side), len(some)), np.float32)
            cells[owner[there], at[there]] = 1
            held.append(cells)
        found += held[0] @ held[1].T
    return found.astype(np.int64)


def _links_within(bucket: pa.Table) -> pa.Table:
    """For each set of the components, or pieces of one, in a bucket: the documents whose sets it links with there."""
    keys = [bucket.column(c).to_numpy() for c in ("component", "low", "high", "node")]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys[:3]], axis=0))
    cuts = np.append(np.flatnonzero(new), len(order)).tolist()
    sizes, copies, own = (bucket.column(c).to_numpy()[order] for c in ("n_shingles", "copies", "own"))
    apart = bucket.column("apart").combine_chunks()
    found = np.zeros(len(order), np.int64)
    for a, b in zip(cuts, cuts[1:]):
        rows = np.arange(a, b)
        within = keys[1][a] == keys[2][a]
        left = rows if within else rows[own[rows] == keys[1][a]]
        right = rows if within else rows[own[rows] == keys[2][a]]
        held = {i: np.frombuffer(apart[int(order[i])].as_buffer(), np.uint64) for i in rows.tolist()}
        lengths = {side: np.array([len(held[i]) for i in rows.tolist()]) for side, rows in ((0, left), (1, right))}
        lefts = [held[i] for i in left.tolist()]
        common = _in_both(lefts, lefts if within else [held[i] for i in right.tolist()])
        # what two sets do not share follows from their distances to the centre and what these have in common
        shared = (sizes[left][:, None] + sizes[right] - (lengths[0][:, None] + lengths[1] - 2 * common)) // 2
        links = linked(shared, sizes[left][:, None], sizes[right])
        if within:
            np.fill_diagonal(links, False)
        found[left] += links @ copies[right]
        if not within:
            found[right] += links.T @ copies[left]
    return pa.table({"node": pa.array(keys[3]), "links": pa.array(found)})


def _whole_sets(wanted: DataFrame, described: DataFrame, texts: DataFrame, keep: bool = False) -> DataFrame:
    """The elements of the wanted nodes' sets; only one text of each is read.

    With ``keep`` the ids of these texts are stored, so that Spark knows their size: few of them go to the texts.
    """
    chosen = described.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("wanted_id"))
    ids = chosen.select("wanted_id").distinct()
    if keep:
        ids = stored(ids, "wanted-ids")
    sets = (
        texts.join(ids, texts.doc_id.eqNullSafe(ids.wanted_id), "left_semi")
        .mapInArrow(_sets_of, "node long, elements binary")
        .dropDuplicates(["node"])
    )
    return sets.join(wanted, "node", "left_semi")


def _verified(pairs: DataFrame, described: DataFrame, texts: DataFrame, links: bool) -> DataFrame:
    """Those of the candidate pairs that link, by their whole sets; only the candidates' texts are read into sets.

    With ``links`` also what the two sets do not share (``apart``).
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = checkpointed(_whole_sets(wanted, described, texts))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b")), "b"
    )
    found = met.select("a", "b", "set_a", "set_b").mapInArrow(_linked_pairs, "a long, b long, apart binary")
    return gathered(found if links else found.select("a", "b"))


def jaccard_components(docs: DataFrame, links: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document, one row per row of ``docs``.

    A document's set holds its distinct runs of five words in lower case, or all its words as one run if there are
    fewer. Two documents link if 100 times their shared runs are at least 80 times all their runs; a component's id is
    the smallest ``doc_id`` that links reach. Documents without words, a null text included, link with nothing. Rows
    with a null id take part; a component without any id gets a null one. Repeated rows and ties fall into one
    component. Other columns are not carried. Runs of words and sets are known by 64-bit hashes.

    Equal sets are one node from the start. Nodes with a common signature are candidates. First each signature's
    middle set meets the others; what links is joined to components. Then all pairs of sets with a common signature
    that still lie in different components are compared, so no link between components is lost, but a group of near
    copies isn't compared pair by pair. Groups over ``PIECE`` sets are compared piece by piece in different tasks.

    With ``links`` there is also ``n_links``, the number of other rows that a row links with itself, those of an equal
    set included. Linked sets lie in one component, so all pairs of distinct sets in a component are compared then, those
    of components over ``LINK_PIECE`` sets piece by piece. A set is sent there as its difference from a centre of its
    component, a few bytes for a near copy, and pairs are counted from what these differences have in common.
    """
    rooted = _rooted(docs, links)
    smallest = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *(["n_links"] if links else []),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, and of that id's rows the one whose set has the
    smallest name.

    A row is dropped for its own text only, so rows of one id with texts of their own all stay, and a repeated row leaves
    one. Documents without words and rows without an id stay too. All columns are carried, whatever their names.

    It is decided on short rows which ids go; the texts are moved once. Only ids that occur more than once, or whose rows
    part, need their sets' names to tell rows apart.
    """
    rooted = checkpointed(_rooted(docs).where("doc_id IS NOT NULL").select("doc_id", "node", "root"))
    first = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    # rows without words are like no other, repeated ones too
    judged = rooted.join(first, "root", "left").select(
        "doc_id", "node", F.coalesce(F.col("first") == F.struct("doc_id", "node"), F.lit(True)).alias("stays")
    )
    per_id = judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("stays").alias("any"))
    verdicts = stored(per_id.where("rows > 1 OR NOT any"), "near-copies")
    gone = verdicts.select(F.col("doc_id").alias("id"))
    several = verdicts.where("rows > 1 AND any").select(F.col("doc_id").alias("id"))
    staying = judged.where("stays AND node IS NOT NULL").join(several, judged["doc_id"] == several["id"], "left_semi")
    staying = staying.select(F.col("doc_id").alias("id"), F.col("node").alias("of_set")).distinct()
    # named apart from any column of the documents
    name = max(docs.columns, key=len) + "_set"
    again = docs.join(several, docs["doc_id"] == several["id"], "left_semi").withColumn(name, _set_name(whole_text()))
    worded = again.join(staying, (again["doc_id"] == staying["id"]) & (again[name] == staying["of_set"]), "left_semi")
    once = docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")
    return (
        once.unionByName(worded.dropDuplicates(["doc_id", name]).select(docs.columns))
        .unionByName(again.where(F.col(name).isNull()).select(docs.columns))
    )


@F.arrow_udf(T.LongType())
def _set_name(texts: pa.Array) -> pa.Array:
    return pa.array([set_id(s) if len(s) else None for sets in shingle_sets(texts) for s in sets], pa.int64())


def _rooted(docs: DataFrame, links: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``node`` (its set's name), ``root`` of its component, ``n_links``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    described = checkpointed(
        texts.mapInArrow(_describe, "doc_id long, n_shingles long, node long, sketch binary")
    )
    parts = 4 * shuffle_partitions(spark)
    # the same sets may share signatures of several parts
    shared = checkpointed(
        texts.select("text")
        .mapInArrow(_sign(parts), "part int, packed binary")
        .groupBy("part")
        .applyInArrow(_met_in_part, "signature long, node long, members long")
        .dropDuplicates(["signature", "node"])
    )
    known = described.where("node IS NOT NULL").select("node", "n_shingles", "sketch").dropDuplicates(["node"])

    def pieces(members: DataFrame, most: int = PIECE) -> DataFrame:
        count = F.ceil(F.col("members") / most).cast("int")
        own = F.pmod(F.xxhash64("node"), count)
        other = F.explode(F.sequence(F.lit(0), count - 1))
        return (
            members.withColumn("own", own)
            .withColumn("other", other)
            .withColumn("low", F.least("own", "other"))
            .withColumn("high", F.greatest("own", "other"))
        )

    def candidate_pairs(members: DataFrame, *more: str) -> DataFrame:
        """Many groups to a bucket, which is a task's unit of work."""
        rows = pieces(members).select("signature", "low", "high", "node", "n_shingles", "sketch", *more)
        bucket = F.pmod(F.xxhash64("signature", "low", "high"), F.lit(4 * parts))
        return rows.groupBy(bucket.alias("bucket")).applyInArrow(_bucket_pairs, "a long, b long").distinct()

    stars = candidate_pairs(shared.join(known, "node"))
    near = _verified(gathered(stars), described, texts, links)
    first = gathered(connected(near.select("a", "b")))
    located = shared.join(first.withColumnRenamed("id", "node"), "node", "left").select(
        "signature", "node", "members", F.coalesce("component", "node").alias("component")
    )
    open_groups = (
        located.groupBy("signature")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least < most")
    )
    rest = located.join(open_groups.select("signature"), "signature", "left_semi").join(known, "node")
    others = candidate_pairs(rest, "component")
    more = _verified(gathered(others), described, texts, links)
    roots = connected(near.select("a", "b").unionByName(more.select("a", "b"))).select(F.col("id").alias("node"), "component")
    counted = []
    if links:
        roots = gathered(roots)
        copies = described.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"))
        both = near.unionByName(more)
        either = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
        ends = both.select("apart", F.inline(F.array(*either)))
        degrees = roots.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node")
        # the set with the most links known so far is a component's centre
        centres = gathered(
            degrees.groupBy("component").agg(
                F.count("*").alias("members"), F.max(F.struct("degree", "node"))["node"].alias("centre_node")
            )
        )
        members = gathered(roots.join(centres, "component"))
        # most sets were compared with the centre itself
        direct = ends.join(centres.select(F.col("centre_node").alias("other")), "other").select("node", "apart")
        of_centres = centres.select(F.col("centre_node").alias("node"), F.lit(b"").alias("apart"))
        direct = gathered(direct.dropDuplicates(["node"]).unionByName(of_centres))
        rest = gathered(members.join(direct, "node", "left_anti"))
        count = F.ceil(F.col("members") / LINK_PIECE).cast("int")
        of_rest = centres.join(rest.select("component").distinct(), "component", "left_semi")
        of_centres = of_rest.select(F.col("centre_node").alias("node"))
        # one pass over the texts for both
        sets = checkpointed(_whole_sets(rest.select("node").unionByName(of_centres), described, texts, keep=True))
        # a large component's centre is sent to each of its pieces
        sent = of_rest.join(sets, F.col("centre_node") == F.col("node")).select(
            "component", F.explode(F.sequence(F.lit(0), count - 1)).alias("own"), F.col("elements").alias("centre")
        )
        apart = (
            rest.withColumn("own", F.pmod(F.xxhash64("node"), count))
            .join(sets, "node")
            .join(sent, ["component", "own"])
            .select("node", "elements", "centre")
            .mapInArrow(_from_centre, "node long, apart binary")
        )
        compared = pieces(members.drop("centre_node"), LINK_PIECE).join(
            known.select("node", "n_shingles").join(copies, "node").join(direct.unionByName(checkpointed(apart)), "node"), "node"
        )
        bucket = F.pmod(F.xxhash64("component", "low", "high"), F.lit(4 * parts))
        found = (
            compared.select(
                "component", "low", "high", "own", "node", "n_shingles", "copies", "apart", bucket.alias("bucket")
            )
            .groupBy("bucket")
            .applyInArrow(_links_within, "node long, links long")
            .groupBy("node")
            .agg(F.sum("links").alias("links"))
        )
        described = described.join(copies.join(found, "node", "left"), "node", "left")
        counted = [F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links")]
    return described.join(roots, "node", "left").select(
        "doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("root"), *counted
    )


def _as_group(function, names: list[str], kinds: list[pa.DataType]):
    """A grouped-map function over whole Arrow tables."""
    empty = pa.table([pa.array([], k) for k in kinds], names=names)

    def of_group(group: pa.Table) -> pa.Table:
        found = list(function(iter(group.to_batches())))
        return pa.Table.from_batches(found) if found else empty

    return of_group


_met_in_part = _as_group(_meet, ["signature", "node", "members"], [pa.int64()] * 3)
