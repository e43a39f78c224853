"""License scans by diagonal voting, in DataFrame functions only.

All rolling k-grams of a document's words are joined with the positions of the same k-grams in the license templates.
A match votes for the diagonal, the document position less the template position. Votes are counted by diagonal,
neighbouring diagonals that overlap (an inserted or missing word moves the diagonal) are merged into spans, and spans are
verified by the share of the template's k-grams, compared as words, and by their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates: (label, text). Short notices, and standard sentences of the licenses themselves (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), 0)


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words). The generator keeps the optimizer from computing the words anew at each use."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.array(words_of(text_of(text_col)))).alias("words"))


def grams(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))).otherwise(
        F.array().cast("array<string>")
    )


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(t_hash, t_gram, template, label, t_pos, t_grams): as many rows as the templates have words, so it may be broadcast."""
    rows = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(templates)], "template int, label string, text string")
    own = rows.select("template", "label", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    placed = own.select("template", "label", (F.size("words") - k + 1).alias("t_grams"), F.posexplode(grams(F.col("words"), k)).alias("t_pos", "t_gram"))
    return placed.withColumn("t_hash", F.xxhash64("t_gram"))


def starts_of(words: Column, phrase: str) -> Column:
    """The positions at which the phrase's words stand consecutively."""
    parts = phrase.split()
    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1), lambda i: reduce(lambda a, b: a & b, [F.get(words, i + j) == F.lit(p) for j, p in enumerate(parts)])
    )
    return F.when(F.array_contains(words, parts[-1]), places).otherwise(F.array().cast("array<int>"))


def diagonal_spans(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    k: int = 3,
    band: int = 3,
    coverage: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, template, label, first_word, last_word, votes, score, verified) of every span that got a vote.

    score is the share of the template's k-grams in the span, at most 1; a span is verified at `coverage` and if it is at
    most half as long again as its template. Null and empty texts have no spans; repeated rows and rows of one doc_id
    vote once; extra columns are ignored. A document's spans grow with its length alone, so no key gathers more than one
    document.
    """
    held = with_words(docs, id_col, text_col)
    placed = held.select("doc_id", F.posexplode(grams(F.col("words"), k)).alias("pos", "gram"))
    places = F.broadcast(template_grams(docs.sparkSession, templates, k))
    hits = placed.join(places, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    votes = hits.select("doc_id", "template", "label", "t_grams", "pos", "t_pos").distinct()
    keys = ["doc_id", "template", "label", "t_grams"]
    diagonals = votes.groupBy(*keys, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    order = Window.partitionBy("doc_id", "template").orderBy("diagonal", "lo")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > band) | (F.col("lo") > F.lag("hi").over(order) + k + band)
    spans = diagonals.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    merged = spans.groupBy(*keys, "span").agg(
        F.sum("votes").alias("votes"), F.min("lo").cast("long").alias("first_word"), (F.max("hi") + k - 1).cast("long").alias("last_word")
    )
    score = F.least(F.lit(1.0), F.col("votes") / F.col("t_grams"))
    fits = F.col("last_word") - F.col("first_word") + 1 <= 1.5 * (F.col("t_grams") + k - 1)
    return merged.select(
        "doc_id", "template", "label", "first_word", "last_word", "votes", score.alias("score"), ((score >= coverage) & fits).alias("verified")
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """One row per document: n_words, the base phrases' places and labels, all labels, and a score from 0 to 1.

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest start (null without
    any). labels adds the labels of verified spans. score is the best span's share of its template, 1 with a base place.
    Null and empty texts have no words, no labels and score 0.
    """
    held = with_words(docs, id_col, text_col)
    found = [starts_of(F.col("words"), p).alias(f"at_{i}") for i, p in enumerate(PHRASES)]
    base = held.select("doc_id", F.size("words").cast("long").alias("n_words"), *found)
    at = F.concat(*[F.col(f"at_{i}") for i in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]))
    base = base.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"),
    )
    spans = diagonal_spans(docs, id_col=id_col, text_col=text_col, **how)
    voted = spans.groupBy("doc_id").agg(F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("voted"), F.max("score").alias("best"))
    every = F.array_sort(F.array_union("base", F.coalesce("voted", F.array().cast("array<string>"))))
    return base.join(voted, "doc_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
