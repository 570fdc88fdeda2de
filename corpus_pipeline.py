"""A corpus from raw documents to token ids, in five stages; each stage's rows are written and read by the next."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.llm import mixing, ngram_join, pii, piece_codec, toxicity
from keyferry.llm.common import table, whole_text
from keyferry.llm.queries import VOCABULARY
from keyferry.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the classifier learns from the labelled ones.

    A null or empty text is scored like any other; long texts are scored whole. Repeated rows and rows without an id are
    judged one by one, by text alone. Without documents or labels nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(whole_text(), model) < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; repeated rows leave one row.

    A row goes for its own text only, so rows of one id with texts of their own stay. Documents without words link with
    nothing and all stay. Rows without an id cannot be named, so they stay too. An empty table gives no rows.
    """
    return ngram_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by the names of their kinds. Every row stays; a null text stays null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix draws them, shard by shard in shuffled order.

    Documents without words have no size and are not drawn. Repeated rows and rows without an id take part one by one; a
    null source is a source of its own. An empty table gives no rows.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids`` of their texts, their number ``n_tokens``, and whether decoding gives the text back,
    ``round_trip``. A column of the documents that has such a name is kept as ``doc_ids`` and so on. A null text has no ids.
    """
    for name in docs.columns:
        if name.lower() in ("ids", "n_tokens", "round_trip"):
            free = f"doc_{name}"
            while free.lower() in map(str.lower, docs.columns):
                free = f"doc_{free}"
            docs = docs.withColumnRenamed(name, free)
    coded = piece_codec.coded_column(whole_text(), VOCABULARY)
    # a blank's mark inside a text is decoded as a blank
    same = coded["decoded"] == F.regexp_replace(whole_text(), F.lit(piece_codec.SPACE), F.lit(" "))
    size = F.size(coded["ids"]).cast("long")
    return docs.select("*", coded["ids"].alias("ids"), size.alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the classifier nor the draw nor the piece vocabulary; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
