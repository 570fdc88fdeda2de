"""Helpers the operators share: tables, checkpoints, hashing of whole texts in numpy."""

import os
import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.session import scratch_path

# Odd multipliers; sums of tab[byte] * BASE**position wrap at 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder in ``spark.checkpoint.dir`` and cut from their lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(spark, "checkpoints"))
    return df.checkpoint()


#: Short rows that are worth a task of their own.
ROWS_A_TASK = 4096


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def gathered(df: DataFrame) -> DataFrame:
    """Checkpointed short rows, few of them in few tasks: each task of a shuffle writes files of its own."""
    held = checkpointed(df)
    return held.coalesce(tasks_for(held.count()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def resolved(path: str) -> str:
    """A file given by a path, or by the name of a public vocabulary."""
    return path if os.path.sep in path else tokenizer_path(path)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n; kept and grown in doubling steps."""
    held = _POWERS.get("up")
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _POWERS[name] = np.multiply.accumulate(values)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(byte) * BASE**position over [i, j)."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up, out=sums[1:])
    return sums


def hashes_at(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], alike wherever the same bytes stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * BASE)


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the offsets of its rows; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    found = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[found[0] : found[-1]], found - found[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes each; a longer row is a range of its own."""
    found, start = [], 0
    n = len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        found.append((start, end))
        start = end
    return found


class Recent(dict):
    """Results of a pure function by argument: the newest ``size`` and, until these are full again, those before them.

    It only saves time: results never depend on what is held. Arguments over 64 characters are not kept.
    """

    def __init__(self, make: Callable, size: int = 100_000):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, argument):
        result = self.older.get(argument)
        if result is None:
            result = self.make(argument)
        self._keep(argument, result)
        return result

    def _keep(self, argument, result) -> None:
        if len(argument) <= 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[argument] = result

    def all_of(self, arguments: set, make_all: Callable[[list], list]) -> dict:
        """The results of all arguments; those that are not held are made together."""
        found, new = {}, []
        for argument in arguments:
            result = self.get(argument)
            if result is None:
                result = self.older.get(argument)
                if result is None:
                    new.append(argument)
                    continue
                self._keep(argument, result)
            found[argument] = result
        for argument, result in zip(new, make_all(new)):
            self._keep(argument, result)
            found[argument] = result
        return found


def once_per_worker(name: str, make: Callable):
    """What ``make`` returns, built once in each Python worker process and kept over its tasks."""
    held = sys.modules.setdefault("keyferry_worker_state", ModuleType("keyferry_worker_state")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
