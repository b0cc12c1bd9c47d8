"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of ``2 * STRIDE`` words, one every ``STRIDE`` words, so every run of up to
``STRIDE`` words lies whole in a block. A block matches a template when it holds at least the
template's threshold share of the template's distinct words.

The join is exact. Words are put in one global order, rarest first, by the number of blocks of all
documents that hold them. A template that needs ``o`` common words can only match a block that
shares a word with the template's first ``size - o + 1`` words, within the block's own first
``size - o + 1`` (prefix filter), that has at least ``o`` template words (length filter), and
whose remaining words suffice from there on (positional filter). Words that occur in no template
cannot be shared, so they are dropped before the order is made. The template side is a literal
table, bounded by the templates given, and is broadcast; blocks are never shuffled.

Base phrases are templates that need all their words; the places where the words stand one after
another are then looked up in the matching blocks. A place belongs to the block in whose first
half it starts.

Nulls: a null text is empty and has no words; a null id is returned as it is. Repeated rows give
repeated results. An empty table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, store, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE, THRESHOLD = 32, 0.8


@dataclass(frozen=True)
class Template:
    """A label with the words of a notice. ``phrase``: all words, one after another.

    ``threshold`` is the template's own share of words, for notices too short for the general one.
    """

    label: str
    text: str
    phrase: bool = False
    threshold: float | None = None

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    def needed(self, threshold: float) -> int:
        size = len(set(self.words))
        return size if self.phrase else math.ceil((self.threshold or threshold) * size - 1e-9)


#: Published opening lines of common licenses, and the base phrases.
TEMPLATES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "you may not use this file except in compliance with the License. You may "
             "obtain a copy of the License at"),
    Template("mit", "Released under the MIT License", threshold=1.0),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy "
             "of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without "
             "modification, are permitted provided that the following conditions are met"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under "
             "the terms of the GNU General Public License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", threshold=1.0),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 "
             "International License"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, "
             "v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    templates: Sequence[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
    stride: int = STRIDE,
) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): rows (uid, id, n_words), and one match row per block and template.

    matches: uid, block, template, label, phrase, score (share of the template's words in the
    block), starts (word places of a phrase that the block owns). ``stride`` is at least the
    number of words of any template.
    """
    spark = docs.sparkSession
    if any(len(t.words) > stride for t in templates):
        raise ValueError("stride is shorter than a template")
    vocabulary = sorted({w for t in templates for w in t.words})
    words = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.regexp_extract_all(ascii_lower(text_of(text_col)), F.lit(WORD), F.lit(0)).alias("words"),
    ).withColumn("n_words", F.size("words").cast("long"))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / stride).cast("int")))
    blocks = words.select(
        "uid", "id", "n_words",
        F.posexplode(F.transform(numbers, lambda k: F.slice("words", k * stride + 1, F.lit(2 * stride)))).alias(
            "block", "held"
        ),
    )
    marked = F.transform("held", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word"))))
    held = store(
        blocks.select("uid", "id", "n_words", "block", F.filter(marked, lambda x: x.isNotNull()).alias("held"))
        .filter((F.size("held") > 0) | (F.col("block") == 0)),
        "license-blocks",
    )
    rows = held.filter("block = 0").select("uid", "id", "n_words")

    # The global order: one count per template word.
    word_counts = held.select(F.explode(F.array_distinct("held.word")).alias("word")).groupBy("word").count()
    often = {r["word"]: r["count"] for r in word_counts.collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    entries = []
    for number, t in enumerate(templates):
        need, own = t.needed(threshold), [w for w in order if w in set(t.words)]
        for i, word in enumerate(own[: len(own) - need + 1]):
            entries.append(F.struct(
                F.lit(word).alias("word"), F.lit(number).alias("template"), F.lit(i).alias("i"),
                F.lit(need).alias("need"), F.lit(len(own)).alias("size"), F.lit(t.label).alias("label"),
                F.lit(t.phrase).alias("phrase"), _literal(own).alias("own"),
                _literal(t.words).alias("spelled"),
            ))
    index = spark.range(1).select(F.inline(F.array(*entries)))

    sorted_words = F.array_intersect(_literal(order), F.col("held.word"))
    probes = held.filter(F.size("held") > 0).withColumn("mine", sorted_words).select(
        "uid", "block", "held", "mine", F.posexplode("mine").alias("j", "word")
    )
    n = F.size("mine")
    candidates = probes.join(F.broadcast(index), "word").filter(
        (n >= F.col("need"))
        & (F.col("j") <= n - F.col("need"))
        & (F.least(F.col("size") - F.col("i"), n - F.col("j")) >= F.col("need"))
    )
    common = F.array_intersect("own", "mine")
    verified = candidates.withColumn("common", common).filter(
        (F.size("common") >= F.col("need"))
        & (F.get("common", F.lit(0)) == F.col("word"))  # once per block and template
    )
    begins = F.filter("held", lambda h: (h.word == F.get("spelled", F.lit(0))) & (h.at < stride))
    whole = F.filter(begins, lambda h: F.forall(
        F.transform("spelled", lambda w, i: F.struct((h.at + i).alias("at"), w.alias("word"))),
        lambda want: F.array_contains("held", want),
    ))
    matches = verified.select(
        "uid", "block", "template", "label", "phrase",
        (F.size("common") / F.col("size")).alias("score"),
        F.when(F.col("phrase"), F.transform(
            whole, lambda h: (F.col("block") * stride + h.at).cast("long")
        )).alias("starts"),
    ).filter("not phrase or size(starts) > 0")
    return rows, matches


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best share of a template's words among the matches, 0 without a match.
    """
    rows, matches = scan(docs, id_col, text_col, **options)

    def joined(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    found = matches.groupBy("uid").agg(
        F.sum(F.when(F.col("phrase"), F.size("starts")).otherwise(0)).alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    return rows.join(found, "uid", "left").select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
