"""Licence notices in texts: phrases, and an exact set-similarity join with notice templates.

A template is contained in a block of words if at least ``threshold`` of its distinct words are in
it, and among them those that tell it from its siblings. Words of templates are ordered by document
frequency over all documents, the rarest first. To reach the containment a block must hold one of the
first ``|T| - a + 1`` words of the template (``a``: words needed), so only blocks with such a prefix
word are joined; the length bound (enough template words in the block) and the positional bound
(enough left after the matched place) drop most of those before the exact count. Blocks are as long as
the template asks for, at least 64 words, and start every half.

Only column expressions and joins. Texts are cut into words once: a scan keeps the template words each
document holds (for the frequencies) and blocks of those documents that hold enough words of some
template. The templates are a parameter and bounded, so they are broadcast; texts are never shuffled.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import stored, texts

# What stands between words, phrases with their labels, and notices with theirs and with
# the words that a sibling lacks.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except "
                   "in compliance with the license you may obtain a copy of the license at http www apache org "
                   "licenses license 2 0 unless required by applicable law or agreed to in writing software "
                   "distributed under the license is distributed on an as is basis without warranties or "
                   "conditions of any kind either express or implied", "apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met", "redistribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc sa"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the "
                "gnu general public license as published by the free software foundation either version 3 of "
                "the license or at your option any later version", "gnu 3"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files", "hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software and to permit persons to whom the software is furnished to do so subject to "
            "the following conditions the above copyright notice and this permission notice shall be included in "
            "all copies or substantial portions of the software", "hereby granted"),
)
#: Words of a block at least; a block holds twice the notice, so one that starts every half holds it whole.
BLOCK = 64


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, BETWEEN), "")


def block_of(notice: str, block: int = BLOCK) -> int:
    """Words of the blocks that a notice is looked for in: a power of two times ``block``."""
    while block < 2 * len(notice.split()):
        block *= 2
    return block


def needed_of(notice: str, threshold: float) -> int:
    return ceil(threshold * len(set(notice.split())) - 1e-9)


def vocabulary(templates) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def phrase_places(phrase: str) -> Column:
    """Starts of a phrase among ``words``; only texts that hold all its words are searched."""
    parts = phrase.split()
    n = F.size("words") - len(parts)
    match = lambda i: _all(F.col("words")[i + j] == p for j, p in enumerate(parts))
    found = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), match)
    likely = _all(F.array_contains("words", p) for p in parts) & (n >= 0)
    return F.when(likely, found).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def prefix_table(spark, templates, order: dict[str, int], threshold: float, block: int) -> DataFrame:
    """(word, length, template, place, size, needed): each template's prefix words, in global order."""
    rows = []
    for number, (_, notice, _) in enumerate(templates):
        words, needed = sorted(set(notice.split()), key=order.__getitem__), needed_of(notice, threshold)
        for place, word in enumerate(words[: len(words) - needed + 1]):
            values = (word, block_of(notice, block), number, place, len(words), needed)
            rows.append(F.struct(*map(F.lit, values)))
    names = ["word", "length", "template", "place", "size", "needed"]
    return spark.range(1).select(F.inline(F.array(*rows))).toDF(*names)


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``n_base``: places of phrases, the first and last by word number from 0 (null without one);
    label arrays are distinct and sorted, ``labels`` with those of contained templates.
    ``score``: 1 with a phrase, else the best containment that meets the threshold, else 0. Templates are
    (label, notice, words that have to be there), notices of any length.
    A null or empty text has no words; one of any length is cut whole by one task. Every row gives one
    row, repeated rows and ids each their own; an empty table none; other columns are ignored.
    """
    known = vocabulary(templates)
    rows = texts(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words")
    )
    rows = rows.withColumn("held", F.array_intersect("words", strings(known)))
    n = F.size("words")
    lengths = sorted({block_of(notice, block) for _, notice, _ in templates})

    def cut(length: int) -> Column:
        """Template words of each block, where the whole text holds enough of some template."""
        own = [t for t in templates if block_of(t[1], block) == length]
        likely = F.lit(False)
        for _, notice, _ in own:
            both = F.array_intersect("held", strings(sorted(set(notice.split()))))
            likely = likely | (F.size(both) >= needed_of(notice, threshold))
        held = lambda i: F.array_intersect(F.slice("words", i + 1, F.lit(length)), "held")
        return F.when(likely, F.transform(F.sequence(F.lit(0), n - 1, F.lit(length // 2)), held))

    places = F.map_from_arrays(
        strings(PHRASES), F.array(*(phrase_places(p) for p in PHRASES.values()))
    )
    scanned = stored(
        rows.select(
            "row",
            "doc_id",
            n.cast("long").alias("n_words"),
            "held",
            places.alias("places"),
            *(cut(length).alias(f"blocks_{length}") for length in lengths),
        ),
        "license-blocks",
    )
    # at most one figure per word of the templates
    seen = scanned.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    seen = {r.w: r.n for r in seen.collect()}
    order = {w: i for i, w in enumerate(sorted(known, key=lambda w: (seen.get(w, 0), w)))}
    prefixes = prefix_table(docs.sparkSession, templates, order, threshold, block)
    return _labelled(scanned, _contained(scanned, prefixes, templates, order, lengths))


def _contained(
    scanned: DataFrame, prefixes: DataFrame, templates, order: dict[str, int], lengths: list[int]
) -> DataFrame:
    """(row, found, best): labels of contained templates and the best containment."""
    cut = [
        scanned.select("row", F.lit(length).alias("length"), F.posexplode(f"blocks_{length}").alias("block", "own"))
        for length in lengths
    ]
    blocks = cut[0]
    for more in cut[1:]:
        blocks = blocks.unionByName(more)
    # the template words in global order: what follows a matched place is what is left
    blocks = blocks.withColumn("own", F.array_intersect(strings(sorted(order, key=order.get)), "own"))
    tokens = blocks.select("row", "length", "own", F.posexplode("own").alias("at", "word"))
    left = F.least(F.col("size") - F.col("place"), F.size("own") - F.col("at"))
    pairs = (
        tokens.join(F.broadcast(prefixes), ["word", "length"])
        .where(F.size("own") >= F.col("needed"))  # length
        .where(left >= F.col("needed"))  # position
    )
    wanted = F.array(*(strings(sorted(set(t.split()))) for _, t, _ in templates))
    telling = F.array(*(strings(must.split()) for *_, must in templates))[F.col("template")]
    overlap = F.size(F.array_intersect("own", wanted[F.col("template")]))
    label = strings(label for label, *_ in templates)[F.col("template")]
    return (
        pairs.where(F.size(F.array_except(telling, "own")) == 0)
        .withColumn("overlap", overlap)
        .where(F.col("overlap") >= F.col("needed"))
        .select("row", label.alias("label"), (F.col("overlap") / F.col("size")).alias("share"))
        .groupBy("row")
        .agg(F.collect_set("label").alias("found"), F.max("share").alias("best"))
    )


def _labelled(scanned: DataFrame, contained: DataFrame) -> DataFrame:
    every = F.flatten(F.map_values("places"))
    base = F.map_keys(F.map_filter("places", lambda _, p: F.size(p) > 0))
    rows = scanned.select(
        "row", "doc_id", "n_words", every.alias("every"), F.sort_array(base).alias("base_labels")
    )
    hit = F.size("every") > 0
    return rows.join(contained, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        "base_labels",
        F.sort_array(
            F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))
        ).alias("labels"),
        F.when(hit, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
