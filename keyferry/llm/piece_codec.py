"""Encoding and decoding with merge-type piece vocabularies, by a score-ordered agenda of adjacent symbol pairs."""

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import Recent, once_per_worker, resolved, slices, utf8_of, whole_text
from keyferry.llm.pieces import SPACE, Vocabulary, merged_parts, read_vocabulary, words_of


def encode_unit(unit: str, vocabulary: Vocabulary) -> list[int]:
    """The ids of one unit: the agenda's best pair is joined until no pair is a piece; the rest falls back to bytes."""
    symbols = list(filter(None, merged_parts(unit, vocabulary.ranks)))
    ids = list(map(vocabulary.ids.get, symbols))
    if None not in ids:
        return ids
    found: list[int] = []
    for symbol, i in zip(symbols, ids):
        found += [i] if i is not None else [vocabulary.byte_ids[b] for b in symbol.encode()]
    return found


#: Units up to this length are encoded together; an agenda's key holds a place in six bits.
LONGEST = 64
#: Units that are encoded at once, and bytes of texts whose words are looked up at once.
UNITS, BYTES = 4096, 250_000
NONE = np.int32(2**31 - 1)


class Agendas:
    """Units encoded side by side, each with its own agenda: a column of keys, score first, then place.

    Symbols are ids. Other characters of pieces have numbers above them, then follow any other character and ``end``, which
    also stands for what was joined to its left neighbour. The pair of symbols a and b lies at ``start[a] + b`` of a table.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.ids = len(vocabulary.texts)
        symbols = dict(vocabulary.ids)
        for c in sorted({c for p in vocabulary.ranks for c in p}.difference(symbols)):
            symbols[c] = self.ids + len(symbols) - len(vocabulary.ids)
        other = self.ids + len(symbols) - len(vocabulary.ids)
        self.end = other + 1
        self.of_code = np.full(0x110000, other, dtype=np.int32)
        self.of_code[:128] = vocabulary.byte_ids[:128]
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_code[ord(s)] = i
        rows = defaultdict(list)
        for piece, rank in vocabulary.ranks.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    rows[a].append((b, rank >> 32 << 6, symbols[piece]))
        self._place(rows)

    def _place(self, rows: dict[int, list[tuple[int, int, int]]]) -> None:
        """Rows of the table lie over one another where the others are free, the longest first."""
        pairs = sum(map(len, rows.values()))
        room = 1 << (4 * pairs).bit_length()
        self.start = np.zeros(self.end + 1, dtype=np.int64)
        self.left, self.rank, self.made = (np.full(room + self.end + 1, v, dtype=np.int32) for v in (-1, NONE, -1))
        draw = np.random.default_rng(1)
        for a, row in sorted(rows.items(), key=lambda item: -len(item[1])):
            b, rank, made = np.array(row).T
            at = draw.integers(room) + b
            while (self.left[at] >= 0).any():
                at = draw.integers(room) + b
            self.start[a] = at[0] - b[0]
            self.left[at], self.rank[at], self.made[at] = a, rank, made

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and piece of pairs of symbols; ``NONE`` where they form no piece."""
        at = self.start[a] + b
        return np.where(self.left[at] == a, self.rank[at], NONE), self.made[at]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, how many each unit has, and which units hold a symbol without an id."""
        n, width = len(units), max(map(len, units))
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=n)
        codes = np.array(units, dtype=f"U{width}").view(np.uint32).reshape(n, width).T
        held = np.where(np.arange(width)[:, None] < sizes, self.of_code[codes], np.int32(self.end))
        symbols = np.append(held, np.full(n, self.end, dtype=np.int32))
        places = np.arange((width + 1) * n)
        right, left = places + n, places - n
        left[:n] += (width + 1) * n
        keys, made = self._pairs(symbols[:-n], symbols[n:])
        keys = np.append(keys | (places[:-n] // n).astype(np.int32), np.full(n, NONE))
        made = np.append(made, np.full(n, -1, dtype=np.int32))
        while True:
            best = keys.reshape(-1, n).min(axis=0)
            unit = np.flatnonzero(best != NONE)
            if not len(unit):
                break
            i = (best[unit] & 63) * n + unit
            j = right[i]
            k, h = right[j], left[i]
            symbols[i], symbols[j] = made[i], self.end
            keys[j] = NONE
            right[i], left[k] = k, i
            for a, b in ((i, k), (h, i)):
                rank, made[a] = self._pairs(symbols[a], symbols[b])
                keys[a] = rank | (a // n).astype(np.int32)
        found = symbols.reshape(-1, n).T
        there = found < self.end
        return found[there], there.sum(axis=1), (there & (found >= self.ids)).any(axis=1)


def encode_units(units: list[str], vocabulary: Vocabulary, agendas: Agendas) -> list[bytes]:
    """The ids of each unit, as the bytes of 32-bit integers."""
    found: list[bytes] = [b""] * len(units)
    order = sorted(range(len(units)), key=lambda n: len(units[n]))
    fit = sum(len(u) <= LONGEST for u in units)
    alone = order[fit:]
    for start in range(0, fit, UNITS):
        block = order[start : min(start + UNITS, fit)]
        ids, counts, odd = agendas.encode([units[n] for n in block])
        data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        for n, a, b in zip(block, [0, *ends], ends):
            found[n] = data[a:b]
        alone += [block[n] for n in np.flatnonzero(odd)]
    for n in alone:
        found[n] = array("i", encode_unit(units[n], vocabulary)).tobytes()
    return found


def encoder(vocabulary: Vocabulary) -> Callable[[list[str]], list[bytes]]:
    """A function from whole texts to the ids of each, as the bytes of 32-bit integers."""

    agendas, kept = Agendas(vocabulary), Recent(None)

    def encode(texts: list[str]) -> list[bytes]:
        words = [words_of(text) for text in texts]
        found = kept.all_of(set().union(*words), lambda new: encode_units([SPACE + w for w in new], vocabulary, agendas))
        return [b"".join(map(found.__getitem__, w)) for w in words]

    return encode


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    """The text of ids: one leading blank goes, bytes that form no character give one replacement mark each."""
    parts: list[bytes] = []
    first = True
    for i in ids:
        piece = vocabulary.texts[i]
        if piece is None:
            continue
        if isinstance(piece, int):
            parts.append(bytes((piece,)))
        else:
            if i == vocabulary.unknown:
                piece = " ⁇ "
            elif first and piece.startswith(SPACE):
                piece = piece[1:]
            parts.append(piece.replace(SPACE, " ").encode())
        first = False
    return _characters(b"".join(parts))


def _characters(data: bytes) -> str:
    found, start = [], 0
    while True:
        try:
            found.append(data[start:].decode())
            return "".join(found)
        except UnicodeDecodeError as error:
            found.append(data[start : start + error.start].decode() + "�")
            start += error.start + 1


def decoder(vocabulary: Vocabulary) -> Callable[[np.ndarray], str]:
    """A function from ids to text; whole characters are looked up, stray bytes are decoded one by one."""
    texts = [
        t.replace(SPACE, " ") if isinstance(t, str) else chr(t) if t is not None and t < 128 else ""
        for t in vocabulary.texts
    ]
    plain = np.array([isinstance(t, str) or t is not None and t < 128 for t in vocabulary.texts])
    plain[vocabulary.unknown] = False

    def decode(ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if not plain[ids].all() or not isinstance(vocabulary.texts[ids[0]], str):
            return decode_ids(ids.tolist(), vocabulary)
        text = "".join(map(texts.__getitem__, ids.tolist()))
        return text[1:] if text.startswith(" ") else text

    return decode


def _id_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    ids = pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)


def _vocabulary(path: str) -> Vocabulary:
    return once_per_worker(f"vocabulary {path}", lambda: read_vocabulary(path))


def _in_slices(texts: pa.Array, path: str, kind: pa.DataType, result: Callable[[list[bytes]], pa.Array]) -> pa.Array:
    """What ``result`` makes of the texts' ids, a slice of the batch at a time."""
    encode = once_per_worker(f"encode {path}", lambda: encoder(_vocabulary(path)))
    found = [
        result(encode([t or "" for t in texts.slice(start, end - start).to_pylist()]))
        for start, end in slices(utf8_of(texts)[1], BYTES)
    ]
    return pa.concat_arrays(found) if found else pa.array([], kind)


def ids_column(text: str | Column, path: str) -> Column:
    """The ids of a text column as ``array<int>``."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _in_slices(texts, path, pa.list_(pa.int32()), _id_lists)

    return encode(text)


def text_column(ids: str | Column, path: str) -> Column:
    """The text of a column of ids."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        text = once_per_worker(f"decode {path}", lambda: decoder(_vocabulary(path)))
        return pa.array([text(row.values.to_numpy()) if row.is_valid else "" for row in lists], pa.string())

    return decode(ids)


def coded_column(text: str | Column, path: str) -> Column:
    """The ids of a text column and the text they give, as ``struct<ids, decoded>``.

    Spark encodes twice where ``text_column`` is applied to ``ids_column`` and both are kept; this encodes once.
    """
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def code(texts: pa.Array) -> pa.Array:
        decode = once_per_worker(f"decode {path}", lambda: decoder(_vocabulary(path)))

        def both(encoded: list[bytes]) -> pa.Array:
            decoded = pa.array([decode(np.frombuffer(e, dtype=np.int32)) for e in encoded], pa.string())
            return pa.StructArray.from_arrays([_id_lists(encoded), decoded], fields=list(kind))

        return _in_slices(texts, path, kind, both)

    return code(text)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of each whole text, one row per row of ``docs``.

    No begin or end ids, no sampling. A null text counts as empty: no ids, an empty text. Texts of any length are
    encoded whole. Other columns are not carried. No shuffle.
    """
    return docs.select("doc_id", coded_column(whole_text(), path).alias("coded")).select("doc_id", "coded.*")


def compare_with_library(docs: DataFrame, path: str) -> DataFrame:
    """Rows whose ids or decoded text differ from the sentencepiece library's, which runs on whole Arrow batches."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=resolved(path))
        vocabulary = read_vocabulary(path)
        encode, decode = encoder(vocabulary), decoder(vocabulary)
        for batch in found:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ours = [np.frombuffer(ids, dtype=np.int32) for ids in encode(texts)]
            theirs = library.encode(texts, num_threads=1)
            same = [
                a.tolist() == b and decode(a) == d
                for a, b, d in zip(ours, theirs, library.decode(theirs, num_threads=1) if texts else [])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(same, pa.bool_())], names=["doc_id", "same"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(batches, "doc_id long, same boolean").where("NOT same").select("doc_id")
