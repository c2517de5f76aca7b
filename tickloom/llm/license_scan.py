"""License scan: phrases, and an exact set-similarity join with templates.

A text block (a line) carries a template if it contains at least the threshold
share of the template's distinct words. Words are put in one global order, by
how many blocks of the corpus have them, rarest first. A block and a template
that share ``need`` words must share one among the first ``size - need + 1`` of
either; that prefix is what is joined on equality. Blocks too short for
a template (length filter) and matches too late in either list to leave room
for ``need`` common words (positional filter) go before the common words are
counted. Every pair that meets the threshold is found.

Words outside all templates cannot be common ones, so a block is reduced to its
words inside them; that leaves its common words as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import let, new_folder, written

# The phrases that always count, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices that public licenses ask for, in their words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

# What separates words once letters are lower case, and the two
# letters outside ASCII whose lower case holds an ASCII letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLDING = r"[\u0130\u212A]"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9


def lowered(text: Column) -> Column:
    """Text with A-Z in lower case; other letters may change, but not to ASCII."""
    return F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), FOLDING, "é"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _places(w: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other, in order."""
    first, *rest = phrase.split()

    def start(word: Column, at: Column) -> Column:
        hit = word == first
        for step, other in enumerate(rest, 1):
            hit = hit & F.coalesce(F.get(w, at + step) == other, F.lit(False))
        return F.when(hit, at)

    return F.array_compact(F.transform(w, start))


PLACES = "array<struct<start:int,label:string>>"


def phrase_places(text: Column) -> Column:
    """Places of all phrases in a lower-case text, with their labels."""
    last = "|".join(sorted({phrase.split()[-1] for phrase, _ in PHRASES}))

    def found(w: Column) -> Column:
        each = [
            F.transform(_places(w, phrase), _labelled(label)) for phrase, label in PHRASES
        ]
        return F.concat(*each).cast(PLACES)

    return F.when(text.rlike(last), let(words(text), found)).otherwise(F.array().cast(PLACES))


def _labelled(label: str):
    return lambda at: F.struct(at.alias("start"), F.lit(label).alias("label"))


def _needs(template: set[str], settings: Settings) -> int:
    return max(1, ceil(settings.threshold * len(template) - 1e-9))


def _blocks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One row per document: base findings, and each line's template words."""
    known = F.array(*map(F.lit, vocabulary))

    def line(text: Column) -> Column:
        return let(
            words(text), lambda w: F.struct(F.size(w).alias("n"), F.array_intersect(known, w).alias("known"))
        )

    lines = let(lowered(F.col("text")), lambda t: F.struct(
        F.transform(F.split(t, "\n"), line).alias("lines"), phrase_places(t).alias("places")
    ))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lines.alias("t")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.aggregate("t.lines", F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("n_words"),
        F.col("t.places").alias("places"),
        F.filter(F.col("t.lines.known"), lambda k: F.size(k) > 0).alias("blocks"),
    )


def _templates(spark: SparkSession, order: dict[str, int], settings: Settings, templates) -> DataFrame:
    """Prefix entries of the templates: (word, place, size, need, label, words)."""
    rows = []
    for label, text in templates:
        own = sorted(set(text.split()), key=order.__getitem__)
        need = _needs(set(own), settings)
        rows += [(word, i, len(own), need, label, own) for i, word in enumerate(own[: len(own) - need + 1])]
    return spark.createDataFrame(
        rows, "word string, place int, size int, need int, label string, template array<string>"
    )


def similar_blocks(blocks: DataFrame, settings: Settings, templates=TEMPLATES) -> DataFrame:
    """``row``, ``label`` and ``score`` of every block and template that meet.

    ``blocks`` has ``row`` and ``known``, the distinct template words of a block.
    The number of blocks of each template word reaches the driver: as many
    numbers as the templates have words.
    """
    vocabulary = sorted({word for _, text in templates for word in text.split()})
    counted = blocks.select(F.explode("known").alias("word")).groupBy("word").count().collect()
    frequency = {r["word"]: r["count"] for r in counted}
    by_rarity = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    order = {word: i for i, word in enumerate(by_rarity)}
    least = min(_needs(set(text.split()), settings) for _, text in templates)

    ordered = blocks.where(F.size("known") >= least).select(
        "row", F.array_intersect(F.array(*map(F.lit, by_rarity)), F.col("known")).alias("known")
    )
    entries = ordered.select("row", "known", F.size("known").alias("length"), F.posexplode("known").alias("at", "word"))
    index = _templates(blocks.sparkSession, order, settings, templates)
    room = F.least(F.col("size") - F.col("place"), F.col("length") - F.col("at"))
    # One row for each prefix word of a template, whatever the data.
    pairs = entries.join(F.broadcast(index), "word").where(
        (F.col("length") >= F.col("need")) & (F.col("at") <= F.col("length") - F.col("need")) & (room >= F.col("need"))
    )
    common = F.size(F.array_intersect("known", "template"))
    return pairs.select("row", "label", "need", common.alias("common"), (common / F.col("size")).alias("score")).where(
        "common >= need"
    )


def scan(docs: DataFrame, settings: Settings = Settings(), templates=TEMPLATES) -> DataFrame:
    """Findings of every row of ``docs``: phrases, places, labels and a score.

    ``base_labels`` are the labels of phrases, ``labels`` adds those of templates;
    both are distinct, sorted and comma-joined, empty if there are none.
    ``score`` is the largest share of a template found in a line, 0 if none
    meets the threshold. Null texts have no word; null ids keep their row.
    """
    vocabulary = sorted({word for _, text in templates for word in text.split()})
    rows = written(_blocks(docs, vocabulary), new_folder(docs.sparkSession, "license-scan"))
    found = similar_blocks(rows.select("row", F.explode("blocks").alias("known")), settings, templates)
    best = found.groupBy(F.col("row").alias("owner")).agg(
        F.collect_set("label").alias("similar"), F.max("score").alias("score")
    )
    starts, base = F.col("places.start"), F.array_distinct(F.col("places.label"))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return rows.join(best, F.col("row") == F.col("owner"), "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, F.coalesce("similar", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
