"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import Recent, once_per_worker, utf8_of, whole_text
from keyferry.llm.pieces import SPACE, Vocabulary, merged_parts, read_vocabulary, words_of

def unit_tokens(unit: str, vocabulary: Vocabulary) -> int:
    """Initial symbols minus merges, where a character outside the vocabulary counts its bytes."""
    parts = merged_parts(unit, vocabulary.ranks)
    merges = parts.count("")
    extra = sum(len(p.encode()) - 1 for p in parts if len(p) == 1 and p not in vocabulary.ids)
    return len(unit) - merges + extra


def counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """A function from a whole text to its number of tokens."""

    kept = Recent(lambda word: unit_tokens(SPACE + word, vocabulary))
    return lambda text: sum(map(kept.__getitem__, words_of(text)))


def counts_column(text: str | Column, path: str) -> Column:
    """Bytes in UTF-8 and tokens of a text column, as ``struct<n_bytes, n_tokens>``."""
    kind = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    @F.arrow_udf("struct<n_bytes:bigint,n_tokens:bigint>")
    def counts(texts: pa.Array) -> pa.Array:
        count = once_per_worker(f"count {path}", lambda: counter(read_vocabulary(path)))
        _, offsets = utf8_of(texts)
        sizes = offsets[1:] - offsets[:-1]
        tokens = [count(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array(sizes), pa.array(tokens, pa.int64())], fields=list(kind))

    return counts(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each whole text, one row per row of ``docs``.

    ``path`` is a model file that every worker can open, or the name of a public vocabulary. A null text counts as
    empty: no bytes, no tokens. Texts of any length are merged whole. Other columns are not carried. No shuffle.
    """
    counted = docs.select("doc_id", counts_column(whole_text(), path).alias("counts"))
    return counted.select("doc_id", "counts.*", (F.col("counts.n_tokens") > limit).alias("over_limit"))
