"""Hash slots: CRC16/XMODEM of the hash tag, modulo 16384."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the slot scheme.
SLOT_COUNT = 16384
CRC_POLYNOMIAL = 0x1021


def _make_slot_udf():
    """The UDF as a closure that carries all it needs, so workers do not have to have this package."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CRC_POLYNOMIAL, table << 1) & 0xFFFF
    table = table.astype(np.uint16)
    slot_count = SLOT_COUNT

    def slots_of_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Slots of many byte strings lying in one buffer, one byte position at a time."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        crc = np.zeros(len(order), dtype=np.uint16)
        longest = int(length[0]) if len(length) else 0
        # longer strings come first, so the ones still running at a position are a prefix
        running = np.searchsorted(-length, -np.arange(longest), side="left")
        for position in range(longest):
            n = running[position]
            head = crc[:n]
            crc[:n] = (head << 8) ^ table[(head >> 8) ^ data[start[:n] + position]]
        slots = np.empty(len(order), dtype=np.int32)
        slots[order] = crc % slot_count
        return slots

    @F.arrow_udf(T.IntegerType())
    def slots_of(keys: pa.Array) -> pa.Array:
        keys = keys.cast(pa.large_binary())
        _, offsets, data = keys.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[keys.offset : keys.offset + len(keys) + 1]
        buffer = np.frombuffer(data if data is not None else b"", dtype=np.uint8)
        slots = slots_of_bytes(buffer, bounds[:-1], np.diff(bounds))
        return pa.array(slots, type=pa.int32(), mask=np.asarray(keys.is_null()))

    return slots_of


_slot_udf = _make_slot_udf()


def hash_tag(key: Column, strict_tag: bool = False) -> Column:
    """The part of a key that is hashed.

    That is the text between the first ``{`` and the next ``}``, or the key when there is no such pair.
    An empty tag hashes the empty text; with ``strict_tag`` it hashes the whole key.
    """
    opened = F.locate("{", key)
    closed = F.locate("}", F.substring(key, opened + 1, F.length(key)))
    tagged = (opened > 0) & (closed > (1 if strict_tag else 0))
    return F.when(tagged, F.substring(key, opened + 1, closed - 1)).otherwise(key)


def slot(key: Column, strict_tag: bool = False) -> Column:
    """Hash slot 0..16383 of a key; a null key, which no scan gives, has slot -1.

    An Arrow UDF over the key column only: the byte loop has no built-in form but an interpreted lambda,
    which took about seven times as long over four million keys. Never being null, the slot gets no
    null check from joins, which would run the UDF a second time.
    """
    return F.coalesce(_slot_udf(hash_tag(key, strict_tag).cast("binary")), F.lit(-1))


def slot_bucket(slot_column: Column, buckets: int) -> Column:
    """Storage bucket of a slot: ``buckets`` contiguous, equally wide slot ranges."""
    if not 1 <= buckets <= SLOT_COUNT:
        raise ValueError(f"buckets must lie in 1..{SLOT_COUNT}")
    return F.floor(slot_column * buckets / SLOT_COUNT).cast("int")
