"""Licence notices in texts, by votes of word k-grams for the diagonals of templates.

A template is a phrase or a notice. All rolling k-grams of all words of a text are hashed and joined with the
hashes of the templates' k-grams; a k-gram at word p of the text and at word t of the template votes for
the diagonal p - t. Votes are added up by diagonal. A word put in or left out moves the rest of a notice to
a neighbouring diagonal, so a notice's neighbouring diagonals are merged into one span. A span is verified by
the template's words that stand in it, each compared as text, and by its length.

Phrases are exact: a span lies on one diagonal and has every word. Notices need ``SHARE`` of a hundred words.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, in small letters. Letters are folded
by ``lower``; the Kelvin sign, the only other character that folds to one of a to z, stays itself.

Everything runs on DataFrame functions. Words are read where they lie: positions, hashes, the join with the
templates and the comparison are one stage over the scan, and only votes are shuffled.

Defined cases: a null or empty text has no words and no labels; each row is a document of its own, also where
rows repeat; a place where two phrases stand counts for each; spans that only partly fit raise the score but give no
label; without templates no text has a label; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm import common

#: Words of a k-gram; a template of fewer words is one k-gram.
WIDTH = 3
#: Diagonals of a notice this near to each other belong together.
DRIFT = 3
#: Of a hundred words of a notice, how many a span must have.
SHARE = 70
#: A span may be so many times as long as its notice.
STRETCH = 2

# Phrases and the labels that they stand for.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# Usual wordings of notices, and the licences that they name.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

TEMPLATES = "template int, label string, phrase boolean, words array<string>"
FOUND = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text: Column) -> Column:
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark: SparkSession, phrases: list[tuple] = PHRASES, notices: list[tuple] = NOTICES) -> DataFrame:
    """Templates as a table; several may have one label."""
    rows = [(label, text, phrase) for group, phrase in ((phrases, True), (notices, False)) for label, text in group]
    numbered = [(i, *row) for i, row in enumerate(rows)]
    table = spark.createDataFrame(numbered, "template int, label string, text string, phrase boolean")
    return table.select("template", "label", "phrase", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)


def _hash(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(words, at + i) for i in range(width)))


def template_positions(known: DataFrame) -> DataFrame:
    """A row for each k-gram of each template: ``template, k, place, hash, gram`` and what the template is."""
    size = F.size("words")
    k = F.least(size, F.lit(WIDTH))
    rows = known.select("template", "label", "phrase", "words", size.alias("size"), k.alias("k"))
    places = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("place"))
    hashed = F.coalesce(*(F.when(F.col("k") == w, _hash(F.col("words"), F.col("place"), w)) for w in range(1, WIDTH + 1)))
    gram = F.array_join(F.slice("words", F.col("place") + 1, F.col("k")), " ")
    return places.select("template", "label", "phrase", "size", "k", "place", hashed.alias("hash"), gram.alias("gram"))


def votes(documents: DataFrame, positions: DataFrame) -> DataFrame:
    """Each k-gram of each text that stands in a template, and one row of each text at least."""
    seen = positions.limit(common.SMALL_ROWS + 1).agg(F.count("*").alias("rows"), F.collect_set("k").alias("widths")).head()
    small = seen.rows <= common.SMALL_ROWS
    widths = sorted(seen.widths) if small and seen.widths else range(1, WIDTH + 1)
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words_of(F.col("text")).alias("_words"))
    rows = rows.select("_row", "doc_id", "_words", F.size("_words").cast("bigint").alias("n_words"))
    rows = rows.select("*", F.posexplode_outer("_words").alias("_at", "_word")).drop("_word")
    hashes = F.array(*(_hash(F.col("_words"), F.col("_at"), w) for w in widths))
    rows = rows.select("*", F.posexplode(hashes).alias("_width", "hash"))
    # The row that stands for its text, whether it meets a template or not.
    rows = rows.withColumn("_first", (F.coalesce("_at", F.lit(0)) == 0) & (F.col("_width") == 0))
    width = F.get(F.array(*map(F.lit, widths)), F.col("_width"))
    text = F.array_join(F.slice("_words", F.col("_at") + 1, width), " ")
    if small:
        # Words are compared in the stage that holds them, after the join.
        met = rows.join(F.broadcast(positions), "hash", "left").withColumn("_text", text)
    else:
        met = rows.withColumn("_text", text).drop("_words").join(positions, "hash", "left")
    # Only where a hash has met one is the text of the words put together.
    same = F.col("gram").isNotNull() & (F.col("_text") == F.col("gram"))
    kept = met.filter(same | F.col("_first"))
    return kept.select(
        "_row", "doc_id", "n_words",
        *(F.when(same, F.col(c)).alias(c) for c in ("template", "label", "phrase", "size", "k", "place")),
        F.when(same, F.col("_at") - F.col("place")).alias("diagonal"), F.when(same, F.col("_at")).alias("at"),
    )


def spans(voted: DataFrame) -> DataFrame:
    """Spans of each text: merged diagonals with the template's words that stand in them.

    A text without any has one row with null ``template``.
    """
    text, template = ["_row", "doc_id", "n_words"], ["template", "label", "phrase", "size", "k"]
    # On one diagonal a template's place occurs once, so these lists are as long as a template at most.
    diagonals = voted.groupBy(*text, *template, "diagonal").agg(
        F.min("at").alias("begin"), (F.max("at") + F.first("k")).alias("end"), F.collect_set("place").alias("places")
    )
    along = W.partitionBy("_row", "template").orderBy("diagonal")
    drift = F.when(F.col("phrase"), 0).otherwise(DRIFT)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > drift, F.lit(True))
    numbered = diagonals.withColumn("_apart", apart.cast("int")).withColumn("span", F.sum("_apart").over(along))
    words = numbered.select(
        *text, *template, "span", "begin", "end",
        F.explode_outer(
            F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))))
        ).alias("word"),
    )
    each = words.groupBy(*text, *template, "span", "word").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return each.groupBy(*text, *template, "span").agg(
        F.count("word").alias("n_found"), F.min("begin").alias("begin"), F.max("end").alias("end")
    ).withColumn("share", F.col("n_found") / F.col("size"))


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Labels of every text: from phrases (``base``), and from phrases and notices together.

    ``first_word`` and ``last_word`` are the first words of the first and the last phrase, ``score`` the
    greatest share of a template's words in one span.
    """
    found = spans(votes(documents, template_positions(known)))
    base = F.col("phrase") & (F.col("n_found") == F.col("size"))
    notice = ~F.col("phrase") & (100 * F.col("n_found") >= SHARE * F.col("size"))
    notice &= F.col("end") - F.col("begin") <= STRETCH * F.col("size")
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    start = F.when(base, F.col("begin")).cast("bigint")
    return found.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        labels(base).alias("base_labels"), labels(base | notice).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).select(*FOUND)
