"""Repeated byte strings across documents, found by backward extension on Burrows-Wheeler transforms.

A string of the minimum length belongs to the anchor that its own bytes decide on: the place of its least k-gram hash.
Equal strings have equal anchors, so texts fall into parts by anchor, and each part has a transform of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import hashes_at, prefix_sums, shuffle_partitions, slices, utf8_of, whole_text

LENGTH = 100
GRAM = 32
#: Anchors in more documents than this send their strings one by one, each to the part of its own hash.
CROWDED = 50_000
RUN_BYTES = 1 << 20
HELD_ANCHORS, HELD_BYTES = 1 << 20, 16 << 20
_PLACE = np.uint64((1 << 32) - 1)
#: Added to the places in rows without an id: texts are shorter, so these rows come last and meet no row with an id.
_BARE = 1 << 32


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The strings of ``length`` bytes in each text, by anchor: first and last start, the anchor's hash, the row."""
    none = np.zeros(0, np.int64)
    gram = min(GRAM, length)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, np.zeros(len(data) + 1, np.uint64)
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = hashes_at(sums, at, at + gram)
    # the least hash decides, then the first place
    least = (hashes & ~_PLACE) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(least))
    inside = offsets[row[starts] + 1] - starts >= length
    starts = starts[inside]
    if not len(starts):
        return none, none, none.astype(np.uint64), none, sums
    anchor = (least[inside] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    return first, last, hashes[anchor[new]], row[first], sums


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = utf8_of(batch.column("text"))
    for a, b in slices(offsets, RUN_BYTES):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _packed_by_part(part: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Equal-length 64-bit columns, one byte string for each part: their number of rows, then the columns."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    return [
        (int(part[a]), b"".join([np.int64(b - a).tobytes(), *[c[a:b].tobytes() for c in columns]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())
        if b > a
    ]


def _anchors_out(length: int, parts: int):
    schema = pa.schema([("part", pa.int32()), ("packed", pa.binary())])

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        marks, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, marks))
        marks, ids = marks[order], ids[order]
        # twice in a document is as good as often
        third = np.zeros(len(marks), dtype=bool)
        third[2:] = (marks[2:] == marks[:-2]) & (ids[2:] == ids[:-2])
        marks, ids = marks[~third], ids[~third]
        rows = _packed_by_part((marks % np.uint64(parts)).astype(np.int32), [marks, ids])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for row, data, offsets in _runs(batch):
                _, _, marks, rows, _ = anchors(data, offsets, length)
                if len(marks):
                    held.append((marks, ids[row + rows]))
                    size += len(marks)
                if size >= HELD_ANCHORS:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return out


def _repeated_anchors(group: pa.Table) -> pa.Table:
    """Of one part, the anchors that occur more than once: document, anchor, and whether too many share it."""
    marks, ids = [], []
    for packed in group.column("packed"):
        raw = np.frombuffer(packed.as_buffer(), np.int64)
        n = int(raw[0])
        marks.append(raw[1 : n + 1].view(np.uint64))
        ids.append(raw[n + 1 :])
    marks, ids = np.concatenate(marks), np.concatenate(ids)
    order = np.lexsort((ids, marks))
    marks, ids = marks[order], ids[order]
    starts = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
    counts = np.repeat(np.diff(np.append(starts, len(marks))), np.diff(np.append(starts, len(marks))))
    keep = (counts > 1) & np.append(True, (marks[1:] != marks[:-1]) | (ids[1:] != ids[:-1]))
    return pa.table(
        {
            "found_id": pa.array(ids[keep]),
            "anchor": pa.array(marks[keep].view(np.int64)),
            "crowded": pa.array(counts[keep] > CROWDED),
        }
    )


def _merged(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document joined."""
    if not len(ids):
        return ids, starts, ends
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order], ends[order]
    # ends that grow over all documents: shift each document beyond the one before
    group = np.cumsum(np.append(False, ids[1:] != ids[:-1]))
    shift = group * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + shift)
    new = np.append(True, starts[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], starts[first], (reach - shift)[last]


def _first_and_later(marks: np.ndarray, names: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of segments in order: which are the first of their mark and name, and which others lie in a later place."""
    new = np.append(True, (marks[1:] != marks[:-1]) | (names[1:] != names[:-1]))
    first = np.flatnonzero(new)
    lead = np.repeat(first, np.diff(np.append(first, len(marks))))
    # a repeated row has the place of its double
    return new, (ids != ids[lead]) | (firsts != firsts[lead])


def _segments_out(length: int, parts: int):
    """The text around each repeated anchor, once for equal ones of a task; the others are known to be covered."""
    schema = pa.schema([("part", pa.int32()), ("packed", pa.binary()), ("content", pa.binary())])

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        marks, names, ids, firsts, sizes = (np.concatenate(x) for x in list(zip(*held))[:5])
        texts = [t for h in held for t in h[5]]
        order = np.lexsort((firsts, ids, firsts >= _BARE, names, marks))
        marks, names, ids, firsts, sizes = (x[order] for x in (marks, names, ids, firsts, sizes))
        new, again = _first_and_later(marks, names, ids, firsts)
        covered = _merged(ids[again], firsts[again], firsts[again] + sizes[again])
        # rows without content only pass on what is covered
        spread = (covered[0] % parts).astype(np.int32)
        rows = [(p, packed, None) for p, packed in _packed_by_part(spread, list(covered))]
        keep = np.flatnonzero(new)
        part = (marks[keep] % np.uint64(parts)).astype(np.int32)
        by_part = np.argsort(part, kind="stable")
        keep, part = keep[by_part], part[by_part]
        packed = _packed_by_part(part, [x[keep] for x in (marks, names, ids, firsts, sizes)])
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        where = order[keep].tolist()
        rows += [
            (p, data, b"".join([texts[i] for i in where[a:b]]))
            for (p, data), a, b in zip(packed, cuts[:-1].tolist(), cuts[1:].tolist())
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            base = np.where(batch.column("bare").to_numpy(zero_copy_only=False).astype(bool), _BARE, 0)
            wanted, crowded = batch.column("anchors"), batch.column("crowded")
            for row, data, offsets in _runs(batch):
                first, last, marks, rows, sums = anchors(data, offsets, length)
                if not len(marks):
                    continue
                # anchors of a row against the row's list: pairs of row and anchor, searched in sorted order
                n = len(offsets) - 1
                lists, flags = wanted.slice(row, n), crowded.slice(row, n)
                of_row = np.repeat(np.arange(n), np.array([len(x) for x in lists], dtype=np.int64))
                listed = lists.flatten().to_numpy().view(np.uint64)
                flagged = flags.flatten().to_numpy(zero_copy_only=False).astype(bool)
                key = listed ^ (of_row.astype(np.uint64) << np.uint64(40))
                order = np.argsort(key)
                key, of_row, listed, flagged = key[order], of_row[order], listed[order], flagged[order]
                mine = marks ^ (rows.astype(np.uint64) << np.uint64(40))
                at = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
                hit = (key[at] == mine) if len(key) else np.zeros(len(mine), dtype=bool)
                many = hit & (flagged[at] if len(key) else False)
                some = hit & ~many
                f, e, m, r = first[some], last[some] + length, marks[some], rows[some]
                if many.any():
                    counts = last[many] - first[many] + 1
                    single = np.repeat(first[many] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
                    f, e = np.append(f, single), np.append(e, single + length)
                    m = np.append(m, hashes_at(sums, single, single + length))
                    r = np.append(r, np.repeat(rows[many], counts))
                if not len(f):
                    continue
                names = hashes_at(sums, f, e)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(f.tolist(), e.tolist())]
                held.append((m, names, ids[row + r], f - offsets[r] + base[row + r], e - f, texts))
                size += int((e - f).sum())
                if size >= HELD_BYTES:
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent(held)

    return out


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by prefix doubling from packed symbols."""
    n = len(symbols)
    per_key = 7
    padded = np.append(symbols.astype(np.uint64), np.zeros(per_key, np.uint64))
    key = np.zeros(n, np.uint64)
    for i in range(per_key):
        key = key << np.uint64(9) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    width = per_key
    while True:
        sorted_key = key[order]
        rank_in_order = np.cumsum(np.append(False, sorted_key[1:] != sorted_key[:-1]))
        if width >= depth or rank_in_order[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = rank_in_order + 1
        second = np.zeros(n, np.uint64)
        if width < n:
            second[:-width] = rank[width:]
        key = rank * np.uint64(n + 1) + second
        order = np.argsort(key, kind="stable")
        width *= 2


def common_prefix_groups(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each the number of its group: those that share their first ``length`` symbols.

    The rows of the transform start as intervals by first symbol. Level by level every row is extended backwards by the
    symbol before it: where the rows of two neighbours' remainders lie on both sides of a border found in the level
    before, a border of the next larger common prefix lies between the neighbours. Common prefixes thus come out by
    increasing value, each once; at the minimum length the search stops, and what has no border by then is equal.
    Symbol 0 separates texts.
    """
    order = suffix_order(symbols, length + 1)
    n = len(order)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    heads = symbols[order]
    border = np.ones(n, dtype=bool)
    border[1:] = (heads[1:] != heads[:-1]) | (heads[1:] == 0)
    open_rows = np.flatnonzero(~border)
    # backward extension: the remainder's rows of each open row and of the row before it
    here, before = row_of[order[open_rows] + 1], row_of[order[open_rows - 1] + 1]
    low, high = np.minimum(here, before), np.maximum(here, before)
    newest = border
    for _ in range(length - 1):
        passed = np.cumsum(newest, dtype=np.int32)
        hit = passed[high] > passed[low]
        if not hit.any():
            break
        newest = np.zeros(n, dtype=bool)
        newest[open_rows[hit]] = True
        border = border | newest
        open_rows, low, high = open_rows[~hit], low[~hit], high[~hit]
    return order, np.cumsum(border)


def _covered_out(length: int):
    names = ["id", "start", "end"]

    def covered(group: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        contents = []
        for packed, content in zip(group.column("packed"), group.column("content")):
            raw = np.frombuffer(packed.as_buffer(), np.int64)
            n = int(raw[0])
            if not content.is_valid:
                found.append(tuple(raw[1:].reshape(3, n)))
                continue
            for held, values in zip(columns, raw[1:].reshape(5, n)):
                held.append(values)
            contents.append(np.frombuffer(content.as_buffer(), np.uint8))
        if contents:
            marks, texts, ids, firsts, sizes = (np.concatenate(c) for c in columns)
            data = np.concatenate(contents)
            begins = np.append(0, np.cumsum(sizes)[:-1])
            order = np.lexsort((firsts, ids, firsts >= _BARE, texts, marks))
            new, later = _first_and_later(marks[order], texts[order], ids[order], firsts[order])
            again = order[later]
            found.append((ids[again], firsts[again], firsts[again] + sizes[again]))
            order = order[new]
            # an anchor with one text only has nothing to be compared with
            new = np.append(True, marks[order][1:] != marks[order][:-1])
            counts = np.diff(np.append(np.flatnonzero(new), len(order)))
            order = order[np.repeat(counts > 1, counts)]
            if len(order):
                found.append(_repeats(data, begins[order], sizes[order], ids[order], firsts[order], length))
        if not found:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        merged = _merged(*(np.concatenate(c) for c in zip(*found)))
        return pa.table({n: pa.array(c) for n, c in zip(names, merged)})

    return covered


def _repeats(data, begins, sizes, ids, firsts, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the strings among different segments that also start in an earlier place."""
    total = int(sizes.sum()) + len(sizes)
    at = np.append(0, np.cumsum(sizes + 1)[:-1])
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(total) - at[segment]
    text = inside < sizes[segment]
    symbols = np.zeros(total, np.uint16)
    symbols[text] = data[(begins[segment] + inside)[text]].astype(np.uint16) + 1
    order, group = common_prefix_groups(symbols, length)
    whole = inside[order] + length <= sizes[segment[order]]
    order, group = order[whole], group[whole]
    owner, start = ids[segment[order]], firsts[segment[order]] + inside[order]
    by_group = np.lexsort((start, owner, start >= _BARE, group))
    owner, start, group = owner[by_group], start[by_group], group[by_group]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lead = np.repeat(first, np.diff(np.append(first, len(group))))
    later = (owner != owner[lead]) | (start != start[lead])
    return owner[later], start[later], start[later] + length


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        data, offsets = utf8_of(batch.column("text"))
        raw = data.tobytes()
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("id", "bare", "ranges"))
        for n, (i, bare, ranges) in enumerate(zip(*columns)):
            text = raw[offsets[n] : offsets[n + 1]]
            kept, at, removed, spans = [], 0, 0, 0
            base = _BARE if bare else 0
            own = [(r["start"] - base, r["end"] - base) for r in ranges or () if (r["start"] >= _BARE) == bare]
            if own:
                starts, ends = zip(*own)
                _, starts, ends = _merged(np.zeros(len(starts), np.int64), np.array(starts), np.array(ends))
                for a, b in zip(starts.tolist(), ends.tolist()):
                    kept.append(text[at:a])
                    at, removed, spans = b, removed + b - a, spans + 1
            kept.append(text[at:])
            rows.append((None if bare else i, len(text), removed, spans, b"".join(kept)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], names=names
            )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes) of every document.

    A byte goes if a string of ``length`` bytes covers it that also starts in an earlier place: in a document with a
    smaller id, or earlier in the same one. All strings are judged on the whole input. Texts are UTF-8 bytes; a null
    text is empty. Rows that share an id count as one document, in which equal starts are the same
    place, so a repeated row does not remove its double, and each of the rows loses what any of them loses at its
    place. Each row without an id is a document of its own; these come last, by a hash of their text, and of equal
    ones only one keeps its text. Other columns are not carried; one row per row of ``docs``.

    Only hashes of anchors are shuffled for the whole corpus. Documents that hold repeated anchors send the text around
    these, each distinct text once per task; texts whose anchor has no other text are never sorted.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    parts = 4 * n
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    bare = F.col("id").isNull()
    # equal texts without an id are numbered by their count; shorter ones hold no string and need no number
    numbered = bare & (F.octet_length("text") >= length)
    own = (
        rows.where(numbered)
        .groupBy("text")
        .agg(F.count("*").alias("copies"))
        .select("text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("number"))
        .select(F.xxhash64("text", "number").alias("id"), "text", F.lit(True).alias("bare"))
    )
    keyed = (
        rows.where(~numbered)
        .select(F.coalesce("id", F.xxhash64("text")).alias("id"), "text", bare.alias("bare"))
        .unionByName(own)
    )
    repeated = (
        keyed.mapInArrow(_anchors_out(length, parts), "part int, packed binary")
        .groupBy("part")
        .applyInArrow(_repeated_anchors, "found_id long, anchor long, crowded boolean")
        .groupBy("found_id")
        .agg(F.collect_list(F.struct("anchor", "crowded")).alias("held"))
        .select("found_id", F.col("held.anchor").alias("anchors"), F.col("held.crowded").alias("crowded"))
    )
    placed = keyed.repartition(n, "id")
    ranges = (
        placed.join(repeated, placed.id == repeated.found_id)
        .select("id", "text", "bare", "anchors", "crowded")
        .mapInArrow(_segments_out(length, parts), "part int, packed binary, content binary")
        .groupBy("part")
        .applyInArrow(_covered_out(length), "id long, start long, end long")
        .groupBy("id")
        .agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
        .withColumnRenamed("id", "found_id")
    )
    return (
        placed.join(ranges, placed.id == ranges.found_id, "left")
        .select("id", "text", "bare", "ranges")
        .mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )
