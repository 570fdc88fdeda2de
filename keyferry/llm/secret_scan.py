"""Secrets in whole texts by a trigram inverted index; DataFrame functions only.

Every rule's pattern yields a Boolean trigram query. The index holds a posting (trigram, doc_id) for each trigram of
those queries; intersecting the postings of a query gives the documents its rule can match, and only these are matched
with the pattern itself. A rule without mandatory trigrams is matched with every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import whole_text

# Private-use marks set around matches; a text's own are exchanged for a third, which no rule can match.
MARK, SPLIT, OTHER = "\ue000", "\ue001", "\ue002"
MOST_ALTERNATIVES = 64
MOST_SET = 8
CHUNK = 512
SPANS = "array<struct<start:int,kind_no:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` then ``value``, in Java's and Python's common syntax, without capturing groups.

    A match counts if its value has ``least`` code points or more; a match that fails is not tried again.
    """

    kind: str
    head: str
    value: str
    least: int = 1


#: The first three are base kinds, always reported; the rest are added by this scan.
RULES = (
    Rule(
        "assign",
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?",
        r"[A-Za-z0-9+/_.=-]+",
        12,
    ),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 14),
    # a run of 16 or more is the whole run, so shorter ones need not be matched to be dropped
    Rule("hex", r"", r"[0-9a-f]{16,}", 16),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-", r"[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_", r"[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ", r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN\x20", r"(?:[A-Z]+\x20)?PRIVATE\x20KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


def _pieces(tokens) -> list[tuple[str | None, ...]]:
    """The alternatives of a parsed pattern, each a sequence of characters; None stands for anything."""
    found: list[tuple] = [()]
    for kind, value in tokens:
        if kind is op.LITERAL:
            options = [(chr(value),)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= MOST_SET:
            options = [(chr(v),) for _, v in value]
        elif kind is op.SUBPATTERN:
            options = _pieces(value[3])
        elif kind is op.BRANCH:
            options = [p for branch in value[1] for p in _pieces(branch)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            if (least, most) == (0, 1):
                options = [(), *_pieces(inner)]
            elif least:
                options = [(*p, None) for p in _pieces(inner)] if least == 1 else [(None,)]
            else:
                options = [(None,)]
        else:
            options = [(None,)]
        if len(found) * len(options) > MOST_ALTERNATIVES:
            options = [(None,)]
        found = [(*a, *b) for a, b in product(found, options)]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """A pattern's query over lower-cased trigrams: some set of the list must be held in full. Empty: no such query."""
    query = set()
    for pieces in _pieces(parser.parse(pattern)):
        runs = "".join("\0" if c is None else c.lower() for c in pieces).split("\0")
        grams = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not grams:
            return []
        query.add(grams)
    return sorted((q for q in query if not any(other < q for other in query)), key=sorted)


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over the given trigrams: one row (trigram, doc_id) for each that a text holds."""
    low = docs.select("doc_id", F.lower(whole_text()).alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """``doc_id`` and ``rule_nos``, the indexed rules whose trigram query a document meets; None if there is no such rule."""
    needs = [
        (n, m, gram, len(grams))
        for n, rule in enumerate(rules)
        for m, grams in enumerate(trigram_query(rule.head + rule.value))
        for gram in sorted(grams)
    ]
    if not needs:
        return None
    # the rules' own trigrams: as many rows as the rules make, whatever the data
    wanted = docs.sparkSession.createDataFrame(needs, "rule_no int, part int, trigram string, needed long")
    postings = trigram_postings(docs, sorted({gram for _, _, gram, _ in needs}))
    met = (
        postings.join(F.broadcast(wanted), "trigram")
        .groupBy("doc_id", "rule_no", "part")
        .agg(F.count_distinct("trigram").alias("held"), F.first("needed").alias("needed"))
        .where("held = needed")
    )
    return met.groupBy("doc_id").agg(F.collect_set("rule_no").alias("rule_nos"))


def _marked(text: Column, rule: Rule) -> Column:
    """The text cut at matches; every second part is a match, with a mark between head and value."""
    marked = F.regexp_replace(text, F.lit(f"({rule.head})({rule.value})"), F.lit(f"{MARK}$1{SPLIT}$2{MARK}"))
    return F.split(marked, MARK, -1)


def _chunk_spans(chunk: Column, kind_no: int, least: int) -> Column:
    """End position and spans of a chunk of parts that begins with text between matches."""

    def step(state: Column, part: Column) -> Column:
        size = F.char_length(part) - F.when(state.inside, 1).otherwise(0)
        span = F.struct(
            state.pos.alias("start"), F.lit(kind_no).alias("kind_no"), (state.pos + size).alias("end")
        )
        counts = state.inside & (F.char_length(F.substring_index(part, SPLIT, -1)) >= least)
        return F.struct(
            (state.pos + size).alias("pos"),
            (~state.inside).alias("inside"),
            F.when(counts, F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans"),
        )

    start = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast(SPANS).alias("spans")
    )
    return F.aggregate(chunk, start, step)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``secrets``, an array of (start, kind_no, end) by start, then rule; offsets count code points.

    One row per row of ``docs``. A null or empty text has an empty list. Rows with the same or a null id share their
    candidates, which the patterns then verify one by one. Other columns are not carried.

    The postings of a document are counted where its text is read, so what is shuffled is a few short rows per
    document; the texts meet the candidates in one join on ``doc_id``.
    """
    scanned = [n for n, rule in enumerate(rules) if not trigram_query(rule.head + rule.value)]
    texts = docs.select("doc_id", F.translate(whole_text(), MARK + SPLIT, OTHER + OTHER).alias("text"))
    found = candidates(docs, rules)
    if found is None:
        texts = texts.withColumn("rule_nos", F.array().cast("array<int>"))
    else:
        found = found.withColumnRenamed("doc_id", "found_id")
        texts = texts.join(found, texts.doc_id.eqNullSafe(found.found_id), "left").drop("found_id")
    empty = F.array().cast("array<string>")
    parts = texts.select(
        "doc_id",
        *[
            (
                _marked(F.col("text"), rule)
                if n in scanned
                else F.when(F.array_contains("rule_nos", n), _marked(F.col("text"), rule)).otherwise(empty)
            ).alias(f"p{n}")
            for n, rule in enumerate(rules)
        ],
    )

    def chunks(n: int) -> Column:
        # an even chunk length keeps matches at odd places
        starts = F.sequence(F.lit(1), F.greatest(F.size(f"p{n}"), F.lit(1)), F.lit(CHUNK))
        return F.transform(
            starts, lambda i: _chunk_spans(F.slice(f"p{n}", i, F.lit(CHUNK)), n, rules[n].least)
        )

    local = parts.select("doc_id", *[chunks(n).alias(f"c{n}") for n in range(len(rules))])

    def joined(n: int) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("spans"))

        def step(state: Column, chunk: Column) -> Column:
            moved = F.transform(
                chunk.spans,
                lambda s: F.struct(
                    (s.start + state.pos).alias("start"), s.kind_no.alias("kind_no"), (s.end + state.pos).alias("end")
                ),
            )
            return F.struct((state.pos + chunk.pos).alias("pos"), F.concat(state.spans, moved).alias("spans"))

        return F.aggregate(f"c{n}", start, step, lambda s: s.spans)

    return local.select(
        "doc_id", F.array_sort(F.flatten(F.array(*[joined(n) for n in range(len(rules))]))).alias("secrets")
    )
