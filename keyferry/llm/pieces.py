"""Merge-type piece vocabularies: a model file read into plain tables, and how a text falls into independent units."""

import re
import struct
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from operator import add

from keyferry.llm.common import resolved

SPACE = "▁"  # stands for a blank inside pieces
# Piece types of the model file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Runs of blanks go with what follows: no piece of the vocabulary has a blank after another character.
UNIT = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")


@dataclass(frozen=True)
class Vocabulary:
    """Ranks and ids of the pieces that merges may form, byte ids, and the text of each id.

    Ranks order the scores, best first, and are held in the upper 32 bits.
    """

    ranks: dict[str, int]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    texts: tuple[str | int | None, ...]
    unknown: int


def _fields(data: bytes):
    """(number, value) of each field of an encoded message: integers, bytes, or four-byte values."""

    def number(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_vocabulary(path: str) -> Vocabulary:
    """Read a merge-type model with byte fallback, identity normalisation and a leading blank.

    Other models are refused: their texts would need another normalisation or another search.
    """
    with open(resolved(path), "rb") as file:
        data = file.read()
    pieces, trainer, normalizer = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            found = dict(_fields(value))
            score = struct.unpack("<f", found[2])[0] if 2 in found else 0.0
            pieces.append((found[1].decode(), score, found.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
    merges = {p: s for p, s, kind in pieces if kind == NORMAL}
    kinds = {kind for _, _, kind in pieces}
    if trainer.get(3) != 2 or not plain or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
        raise ValueError(f"{path} is no plain merge-type model with byte fallback")
    if any(a != SPACE and b == SPACE for p in merges for a, b in zip(p, p[1:])):
        raise ValueError(f"{path} has pieces over word boundaries")
    texts = [
        int(p[3:5], 16) if kind == BYTE else None if kind == CONTROL else p for p, _, kind in pieces
    ]
    levels = {score: n << 32 for n, score in enumerate(sorted(set(merges.values()), reverse=True))}
    return Vocabulary(
        {p: levels[score] for p, score in merges.items()},
        {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL},
        tuple(i for _, i in sorted((int(p[3:5], 16), i) for i, (p, _, kind) in enumerate(pieces) if kind == BYTE)),
        tuple(texts),
        next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN),
    )


def words_of(text: str) -> list[str]:
    """The parts of a text that no piece spans, in order, each without the blank's mark that it begins with.

    A text starts with a blank's mark, so every part does. An empty text has no parts.
    """
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return UNIT.findall(SPACE + text.replace(" ", SPACE))
    return text.split(" ")


def merged_parts(unit: str, ranks: dict[str, int]) -> list[str]:
    """The unit's characters after all merges; a part joined to its left neighbour is left empty.

    A heap holds the adjacent pairs by rank, then place, each as one integer; neighbours form a linked list. A pair is
    out of date unless it still stands as its left half's newest.
    """
    parts = list(unit)
    n = len(parts)
    get = ranks.get
    standing = [-1] * n
    heap = []
    for i, rank in enumerate(map(get, map(add, unit, unit[1:]))):
        if rank is not None:
            standing[i] = key = rank | i
            heap.append(key)
    heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        key = heappop(heap)
        i = key & 0xFFFFFFFF
        if standing[i] != key:
            continue
        j = right[i]
        parts[i] = new = parts[i] + parts[j]
        parts[j] = ""
        standing[i] = standing[j] = -1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            rank = get(new + parts[k])
            if rank is not None:
                standing[i] = key = rank | i
                heappush(heap, key)
        h = left[i]
        if h >= 0:
            rank = get(parts[h] + new)
            if rank is None:
                standing[h] = -1
            else:
                standing[h] = key = rank | h
                heappush(heap, key)
    return parts
