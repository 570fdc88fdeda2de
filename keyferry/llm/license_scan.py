"""Licences named in whole texts by a positional index of rare words; DataFrame functions only.

Every template has a mandatory key phrase inside its notice. The index holds the phrases' words with their positions. A
file's licence words are looked up, the rarest of the corpus (highest IDF) first: where the rarest word of a phrase stands
gives the places at which the phrase may begin, the second rarest word is intersected with them by relative position, and
at what is left the whole phrase is verified. Every word of a phrase has to be there, so no place is lost, whatever words
are the rarest.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.llm.common import whole_text

# Fixed value: what stands between words once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's label, its key phrase, and words that stand before and after the phrase in a usual notice."""

    label: str
    phrase: str
    before: str = ""
    after: str = ""
    base: bool = False

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def notice(self) -> list[str]:
        return f"{self.before} {self.phrase} {self.after}".split()


# The base phrases, then sentences of public licence notices.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        after="of this software and associated documentation files the software to deal in the software without restriction",
    ),
    Template("apache-2", "apache org licenses license 2 0", before="http www"),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template("mit", "spdx license identifier mit"),
    Template("gpl-3", "gnu general public license version 3", before="this work is licensed under the"),
    Template("gpl-2", "gnu general public license version 2", before="this work is licensed under the"),
    Template(
        "gpl-3",
        "gnu general public license as published by the free software foundation either version 3",
        before="you can redistribute it and or modify it under the terms of the",
        after="of the license or at your option any later version",
    ),
    Template(
        "gpl-2",
        "gnu general public license as published by the free software foundation either version 2",
        before="you can redistribute it and or modify it under the terms of the",
        after="of the license or at your option any later version",
    ),
    Template("agpl-3", "gnu affero general public license", before="under the terms of the", after="version 3"),
    Template("lgpl", "gnu lesser general public license", before="under the terms of the", after="version"),
    Template("mpl-2", "mozilla public license v 2 0", before="this source code form is subject to the terms of the"),
    Template("mpl-2", "mozilla public license version 2", before="under the"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        after="provided that the following conditions are met",
    ),
    Template("bsd", "under the bsd license"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        after="provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "unlicense",
        "free and unencumbered software released into the public domain",
        before="this is",
    ),
    Template("cc-by-nc", "creative commons attribution noncommercial", before="licensed under a", after="license"),
    Template("cc-by-sa", "creative commons attribution sharealike", before="licensed under a", after="license"),
    Template("cc-by", "creative commons attribution 4 0", before="licensed under a", after="international license"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "cc by sa", before="licensed under", after="4 0"),
    Template("cc0", "cc0 1 0", before="licensed under", after="universal"),
)


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then runs of digits, letters a-z and anything beyond ASCII."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def license_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({word for template in templates for word in template.key})


def word_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of every word of the key phrases over all rows of ``docs``; only one row per such word is returned."""
    vocabulary = F.array(*map(F.lit, license_words(templates)))
    held = docs.select(F.explode(F.array_append(F.array_intersect(words_of(whole_text()), vocabulary), "")).alias("word"))
    found = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    # every row has the empty word once
    rows = found.get("", 0)
    return {word: math.log((1 + rows) / (1 + found.get(word, 0))) for word in license_words(templates)}


def _index(templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """The templates as one array, each with its two rarest words and their positions in the key phrase."""

    def entry(template: Template) -> Column:
        key = template.key
        rare = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))
        first, second = rare[0], rare[min(1, len(rare) - 1)]
        texts = lambda words: F.array(*map(F.lit, words))
        return F.struct(
            F.lit(template.label).alias("label"),
            F.lit(template.base).alias("base"),
            texts(key).alias("key"),
            texts(template.notice).alias("notice"),
            F.lit(len(template.before.split())).alias("offset"),
            F.lit(key[first]).alias("first"),
            F.lit(first).alias("first_at"),
            F.lit(key[second]).alias("second"),
            F.lit(second).alias("second_at"),
        )

    return F.array(*map(entry, templates))


def _starts(postings: Column, word: Column, at: Column) -> Column:
    """Where a phrase begins if ``word`` is its ``at``-th word."""
    return F.transform(F.filter(postings, lambda p: p.word == word), lambda p: p.pos - at)


def _share(words: Column, start: Column, template: Column) -> Column:
    """Which share of a notice's words stand in their places when its key phrase begins at ``start``."""
    n = F.size(template.notice)
    same = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0),
        lambda s, i: s + F.when(F.get(words, start - template.offset + i) == F.get(template.notice, i), 1).otherwise(0),
    )
    return same.cast("double") / n


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``n_words`` and ``places``: an array of (start, label, base, share) by start; starts count words from 0.

    ``share`` is the part of the notice around the key phrase that stands in its place. One row per row of ``docs``,
    repeated ids and null ids too; a null or empty text has no words and no places; no rows give no rows. Other columns
    are not carried. Texts are read twice, once for the word counts, and never shuffled; a long text takes memory in
    proportion to its words, in the task that reads it.
    """
    idf = word_idf(docs, templates)
    vocabulary = F.array(*map(F.lit, license_words(templates)))
    found = docs.select("doc_id", words_of(whole_text()).alias("words"))
    found = found.withColumn("held", F.array_intersect("words", vocabulary))
    # the rarest words first: few files hold them
    whole = lambda t: (
        F.array_contains("held", t["first"])
        & F.array_contains("held", t["second"])
        & (F.size(F.array_except(t.key, F.col("held"))) == 0)
    )
    found = found.withColumn("possible", F.filter(_index(templates, idf), whole))
    looked_up = F.array_distinct(
        F.flatten(F.transform("possible", lambda t: F.array(t["first"], t["second"])))
    )
    found = found.withColumn("looked_up", looked_up)
    marked = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    found = found.withColumn(
        "postings",
        F.when(
            F.size("possible") > 0, F.filter(marked, lambda p: F.array_contains(F.col("looked_up"), p.word))
        ).otherwise(F.array().cast("array<struct<word:string,pos:int>>")),
    )

    def places(t: Column) -> Column:
        both = F.array_intersect(
            _starts(F.col("postings"), t["first"], t.first_at), _starts(F.col("postings"), t["second"], t.second_at)
        )
        at = F.filter(both, lambda s: (s >= 0) & (F.slice(F.col("words"), F.greatest(s, F.lit(0)) + 1, F.size(t.key)) == t.key))
        return F.transform(
            at,
            lambda s: F.struct(
                s.alias("start"), t.label.alias("label"), t.base.alias("base"), _share(F.col("words"), s, t).alias("share")
            ),
        )

    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array_sort(F.flatten(F.transform("possible", places))).alias("places"),
    )
