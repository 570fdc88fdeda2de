"""How corpus filters interact, for every order in which they can be applied.

Each document is a mask of the filters it fails. Documents of one part and mask are counted into a cell, so what the
orders walk over is at most 2**filters cells a part, whatever the corpus. A recursive query then extends every prefix of
filters by each letter it does not hold, joins the cells and carries the bits applied so far; a level of the recursion
emits the counts of that step.
"""

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import checkpointed, whole_text

# The white space between words, and the marks that filter D looks for.
BLANKS = "\t\n\x0b\x0c\r "
MARKS = "[#$%&*|]"


def words_of(text: Column) -> Column:
    """The words of a text: what stands between blanks."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")


def few_words(text: Column) -> Column:
    return F.size(words_of(text)) < 200


def repetitive(text: Column) -> Column:
    words = words_of(text)
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * 50


def shouting(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 3


def marked(text: Column) -> Column:
    return text.rlike(MARKS)


#: Failure conditions by letter. ``None``: the text is identical to that of a row with a smaller id.
FILTERS: dict[str, Callable[[Column], Column] | None] = {
    "A": few_words,
    "B": repetitive,
    "C": shouting,
    "D": marked,
    "E": None,
}
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """``part``, ``mask``, ``docs``, ``good`` and ``toxic``: the documents of each part (language) by the filters they fail.

    Bit i of a mask is the i-th filter. A null text is an empty one, a null part the empty name. A row without an id is
    no copy and makes none, and has no labels; rows of one id count each and are no copies of each other. Of several
    labels of an id, one that is set suffices. Texts are read once, from then on rows hold a digest (SHA-256) instead.

    The least id of a text comes from an aggregate and is looked up by digest and id, so that the rows of a very common
    text never meet; rows without an id are dealt out by digest where labels are looked up.
    """
    text = whole_text()
    bits = {letter: 1 << i for i, letter in enumerate(filters)}
    own = [F.when(fails(text), bits[letter]).otherwise(0) for letter, fails in filters.items() if fails]
    copy_bit = sum(bits[letter] for letter, fails in filters.items() if fails is None)
    mask = sum(own, F.lit(0))
    short = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            mask.alias("mask"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )
    first = short.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    short = short.join(first.withColumn("is_first", F.lit(True)), ["digest", "doc_id"], "left")
    is_copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest"))
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .withColumn("salt", F.lit(0).cast("long"))
    )
    found = short.select(
        "part",
        (F.col("mask") + F.when(is_copy, copy_bit).otherwise(0)).alias("mask"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        # a salt other than 0 meets no label
        F.when(salt == 0, 1).otherwise(F.coalesce(salt, F.lit(0))).alias("salt"),
    ).join(marks, ["id", "salt"], "left")
    return found.groupBy("part", "mask").agg(
        F.count("*").alias("docs"),
        F.count_if("good").alias("good"),
        F.count_if("toxic").alias("toxic"),
    )


def _walk(packed: DataFrame, filters: dict) -> DataFrame:
    """Every prefix of every order with the counts of its last step."""

    def total(condition: str, counted: str = "docs") -> str:
        return f"aggregate(c.cells, 0L, (s, x) -> s + IF({condition}, x.{counted}, 0L))"

    fails, before = "x.mask & l.bit <> 0", "x.mask & w.applied"
    removed = f"{fails} AND {before} = 0"
    levels = {
        "kept": total(f"x.mask & (w.applied | l.bit) = 0"),
        "removed": total(removed),
        "redundant": total(f"{fails} AND {before} <> 0"),
        "unique_fails": total("x.mask = l.bit"),
        "good_lost": total(removed, "good"),
        "toxic_lost": total(removed, "toxic"),
    }
    letters = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(filters))
    return packed.sparkSession.sql(
        f"""
        WITH RECURSIVE walk (part, prefix, applied, step, {", ".join(COUNTS)}) AS (
          SELECT part, CAST('' AS STRING), 0, 0, {", ".join("0L" for _ in COUNTS)} FROM {{cells}}
          UNION ALL
          SELECT w.part, concat(w.prefix, l.letter), w.applied | l.bit, w.step + 1, {", ".join(levels[c] for c in COUNTS)}
          FROM walk w
          JOIN (VALUES {letters}) l (letter, bit) ON w.applied & l.bit = 0
          JOIN {{cells}} c ON c.part = w.part
          WHERE w.step < {len(filters)}
        )
        SELECT * FROM walk WHERE step > 0 LIMIT ALL
        """,
        cells=packed,
    )


def audit_orders(cells: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """One row per part, order of all filters and step, from ``mask_cells``; no cells give no rows.

    ``kept`` and ``removed`` after and at the step, ``redundant`` (fails here, was removed before), ``unique_fails`` (fails
    this filter alone), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``, what the step's filter removes
    summed over all orders. A prefix is walked once and stands for every order that begins with it.
    """
    cell = F.struct("mask", "docs", "good", "toxic")
    # at most 2**filters cells a part
    packed = checkpointed(cells.groupBy("part").agg(F.array_sort(F.collect_list(cell)).alias("cells")))
    walked = checkpointed(_walk(packed, filters)).withColumn("letter", F.substring("prefix", -1, 1))
    n = len(filters)
    orders_with = F.element_at(F.array(*[F.lit(factorial(n - i)) for i in range(1, n + 1)]), F.col("step"))
    shapley = walked.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_with).alias("shapley"))
    orders = (
        walked.where(F.col("step") == n)
        .select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
        .withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    )
    return (
        orders.join(walked.drop("applied", "step"), ["part", "prefix"])
        .join(shapley, ["part", "letter"])
        .select("part", "filter_order", "step", *COUNTS, "shapley")
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """``audit_orders`` over the cells of whole ``docs`` (``doc_id``, ``text``, ``lang``) and ``labels``; see both."""
    return audit_orders(mask_cells(docs, labels, filters), filters)
