"""Operator 9: license scans by diagonal voting (DataFrame functions only).

Every rolling k-gram of a document's words is hashed and joined to the positions
of the same k-gram in the license templates. A hit at document word p and
template word t votes for the diagonal p - t: words of one copied passage share
a diagonal. Votes are aggregated by diagonal, neighbouring diagonals (a word
inserted or lost shifts the rest of a copy by one) are merged, and a merged span
is verified by the share of the template's k-grams that it holds. How far apart
neighbours may lie grows with the template: a quarter of its k-grams, ``SLACK``
at least. A hit needs two independent hashes of the k-gram to agree.

The template table is a constant of a few hundred rows, so it is broadcast. A
document's votes are bounded by its own length times the templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import keyed_text, lower_az

K = 3
SLACK = 2          # diagonals that far apart still belong together,
GRAMS_A_STEP = 4   # and one more for each so many k-grams of a longer template
MIN_COVER = 0.7    # of a template's k-grams, for its label

# Label and wording of the notices that are looked for.
TEMPLATES = [
    ("agpl", "GNU Affero General Public License"),
    ("all-rights-reserved", "All rights reserved."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

# Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; null text has none."""
    parts = F.split(lower_az(F.coalesce(text, F.lit(""))), _SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Two hashes of every rolling k-gram, by position."""
    def at(i: Column) -> Column:
        gram = F.slice(words, i, k)
        return F.struct(F.xxhash64(gram).alias("h"), F.hash(gram).alias("check"))

    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), at)).otherwise(
        F.array().cast("array<struct<h:bigint,check:int>>"))


def template_positions(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """``template, label, t_pos, h, check, t_grams``: one row per k-gram."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)],
                                 "template int, label string, text string")
    rows = rows.select("template", "label", grams(words_of(F.col("text")), k).alias("g"))
    return rows.select("template", "label", F.size("g").alias("t_grams"), F.posexplode("g").alias("t_pos", "g")).select(
        "template", "label", "t_grams", "t_pos", F.col("g.h").alias("h"), F.col("g.check").alias("check"))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
          k: int = K, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans: ``doc_id, text_key, template, label, first_word,
    last_word, cover`` (share of the template's k-grams)."""
    words = keyed_text(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"),
                                                    words_of(F.col("text")).alias("words"))
    grammed = words.select("doc_id", "text_key", grams(F.col("words"), k).alias("g"))
    # outer: else the optimiser filters on size(g) below, with the splitting inside the lambda
    rolled = grammed.select("doc_id", "text_key", F.posexplode_outer("g").alias("pos", "g")).select(
        "doc_id", "text_key", "pos", F.col("g.h").alias("h"), F.col("g.check").alias("check"))
    known = template_positions(df.sparkSession, templates, k)
    hits = rolled.join(F.broadcast(known), ["h", "check"])  # the templates are a constant
    doc = ["doc_id", "text_key", "template", "label", "t_grams"]
    votes = (hits.withColumn("diagonal", F.col("pos") - F.col("t_pos")).groupBy(*doc, "diagonal")
             .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("t_pos").alias("t")))
    by_diagonal = Window.partitionBy(*doc).orderBy("diagonal")
    slack = F.greatest(F.lit(SLACK), (F.col("t_grams") / GRAMS_A_STEP).cast("int"))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > slack, F.lit(False))
    merged = (votes.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(by_diagonal))
              .groupBy(*doc, "passage").agg(F.min("lo").alias("first_word"), (F.max("hi") + (k - 1)).alias("last_word"),
                                            F.size(F.array_distinct(F.flatten(F.collect_list("t")))).alias("held")))
    cover = F.col("held") / F.col("t_grams")
    return merged.withColumn("cover", cover).filter(F.col("cover") >= min_cover).select(
        "doc_id", "text_key", "template", "label", "first_word", "last_word", "cover")


def base_places(words: Column, text: Column) -> Column:
    """(label, start) of every base phrase, in no special order. Every phrase
    ends in the same word, so other documents are not searched."""
    def starts(phrase: list[str], label: str) -> Column:
        def hit(w: Column, i: Column) -> Column:
            back = len(phrase) - 1
            same = (w == phrase[-1]) & (i >= back)
            for j, word in enumerate(phrase[:-1]):
                same = same & F.coalesce(F.get(words, i - (back - j)) == word, F.lit(False))
            return F.when(same, F.struct(F.lit(label).alias("label"), (i - back).alias("start")))
        return F.filter(F.transform(words, hit), lambda x: x.isNotNull())

    empty = F.array().cast("array<struct<label:string,start:int>>")
    found = F.concat(*[starts(p.split(" "), label) for p, label in PHRASES])
    return F.when(F.contains(lower_az(text), F.lit("license")), found).otherwise(empty)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.

    ``score`` is the best cover of any verified span, 0 without one. Null or
    empty text has no words, no labels (empty strings) and score 0; its places
    are null. Repeated rows get equal results; an empty table an empty one.
    """
    rows = keyed_text(df, id_col, text_col)
    worded = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"),
                         words_of(F.col("text")).alias("words"))
    places = worded.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
                           base_places(F.col("words"), F.col("text")).alias("places"))
    starts = F.transform("places", lambda p: p["start"])
    base = places.select("doc_id", "text_key", "n_words", F.size("places").cast("long").alias("n_base"),
                         F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                         F.array_distinct(F.transform("places", lambda p: p["label"])).alias("own"))
    found = spans(df, id_col, text_col).groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("more"), F.max("cover").alias("best")).select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "more", "best")
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", more)), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).cast("double").alias("score"))
