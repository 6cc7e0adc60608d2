"""License scan by diagonal voting, in DataFrame functions only.

Texts and templates are cut into words.  Every rolling k-gram of a text is
hashed and joined to the template positions that hold the same k-gram; a hit at
text word i and template word j votes for the diagonal i - j.  Votes are counted
per document, template and diagonal; neighbouring diagonals (words inserted or
left out) are merged, and a merged span counts when the template words that its
k-grams cover reach the template's threshold.  A phrase needs all of its words
on one diagonal, which makes it an exact search.

The join compares the k-gram itself beside its hash, so a vote never rests on a
hash collision.  The template table is a parameter and broadcast; its size is
checked, and larger sets are matched in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch, ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
BLOCK_POSITIONS = 200_000        # template positions broadcast at once (some 20 MB)


@dataclass(frozen=True)
class Template:
    """``phrase``: exact, on one diagonal; otherwise ``threshold`` of the words, with merged diagonals."""
    label: str
    text: str
    phrase: bool = False
    threshold: float = 0.8


#: The phrases of the contract.
PHRASES = [Template("mit", "under the mit license", True, 1.0), Template("apache-2", "apache license version 2", True, 1.0),
           Template("cc-by-nc", "cc by nc", True, 1.0)]

#: Opening passages and notices of public licenses.
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
             "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit", "Released under the MIT License"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def grams_of(words: Column, k: int = K) -> Column:
    """All k-grams in order, space-joined; empty for fewer than k words."""
    n = F.size(words) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                                     lambda i: F.concat_ws(" ", *[words[i + j] for j in range(k)]))
                  ).otherwise(F.array().cast("array<string>"))


def template_positions(spark, templates: list[Template], k: int = K) -> DataFrame:
    """(template, j, gram, h) for every k-gram of every template."""
    for t in templates:
        if len([w for w in t.text.split() if w]) < k:
            raise ValueError(f"template {t.label!r} has fewer than {k} words")
    rows = [(i, t.text) for i, t in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, text string")
    return (df.select("template", F.posexplode(grams_of(words_of(F.col("text")), k)).alias("j", "gram"))
            .withColumn("h", F.xxhash64("gram")))


def scan(docs: DataFrame, templates: list[Template], *, text: str = "text", id_col: str = "doc_id", slack: int = 3,
         k: int = K) -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: id, ``h`` (hash of the text) and n_words; spans: id, h, label,
    phrase, first, last (text words, last included) and coverage.

    Defined cases: a null text is empty and has no words and no spans; rows
    equal in id and text have the same spans, listed once; ids may be null;
    other columns are ignored; an empty table gives two empty ones.  ``slack``
    is how far neighbouring diagonals may lie apart.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    d = d.select("id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    every = d.select("id", "h", F.size("w").cast("long").alias("n_words"))
    exploded = d.select("id", "h", F.posexplode(grams_of(F.col("w"), k)).alias("i", "gram")).withColumn("gh", F.xxhash64("gram"))
    spans, block, size = None, [], 0
    for t in [*templates, None]:
        n = 0 if t is None else len(t.text.split())
        if block and (t is None or size + n > BLOCK_POSITIONS):
            part = _spans(spark, exploded, block, slack, k)
            spans = part if spans is None else spans.unionByName(part)
            block, size = [], 0
        if t is not None:
            block, size = [*block, t], size + n
    return every, spans


def _spans(spark, exploded: DataFrame, templates: list[Template], slack: int, k: int) -> DataFrame:
    pos = template_positions(spark, templates, k)
    meta = spark.createDataFrame([(i, t.label, t.phrase, float(t.threshold)) for i, t in enumerate(templates)],
                                 "template int, label string, phrase boolean, threshold double")
    words = pos.groupBy("template").agg((F.max("j") + k).alias("length"))
    pos = F.broadcast(pos.withColumnRenamed("gram", "t_gram"))                 # at most BLOCK_POSITIONS rows
    hits = exploded.join(pos.withColumnRenamed("h", "t_h"), (F.col("gh") == F.col("t_h")) & (F.col("gram") == F.col("t_gram")))
    votes = hits.select("id", "h", "template", (F.col("i") - F.col("j")).alias("diagonal"), "j").distinct()
    # per diagonal: votes and covered template words (k-grams overlap: a gap of g positions hides min(g, k) new words)
    diagonals = votes.groupBy("id", "h", "template", "diagonal").agg(F.sort_array(F.collect_set("j")).alias("js"))
    diagonals = diagonals.join(F.broadcast(meta.join(words, "template")), "template")
    near = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(near) > slack)
    runs = (diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("new").over(near)))
    runs = runs.groupBy("id", "h", "template", "label", "phrase", "threshold", "length", "run").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("js")))).alias("js"),
        F.min(F.col("diagonal") + F.col("js")[0]).alias("first"),
        F.max(F.col("diagonal") + F.element_at("js", -1) + (k - 1)).alias("last"))
    covered = F.aggregate("js", F.struct(F.lit(0).alias("n"), F.lit(-k).alias("at")), lambda a, j: F.struct(
        (a["n"] + F.least(j - a["at"], F.lit(k))).alias("n"), j.alias("at")), lambda a: a["n"])
    return (runs.withColumn("coverage", covered / F.col("length")).where("coverage >= threshold")
            .select("id", "h", "label", "phrase", "first", "last", "coverage"))


def license_table(docs: DataFrame, templates: list[Template] | None = None, **names) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts phrase places; first_word and last_word are the smallest
    and largest start of one.  ``score`` is the best coverage of any span.
    """
    scratch = Scratch(docs.sparkSession, "license")
    every, spans = scan(docs, templates or [*PHRASES, *NOTICES], **names)
    found = spans.groupBy("id", "h").agg(
        F.sum(F.col("phrase").cast("long")).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    found = scratch.write(found, "found").alias("f")
    e = every.alias("e")
    out = e.join(found, F.col("e.id").eqNullSafe(F.col("f.id")) & (F.col("e.h") == F.col("f.h")), "left")
    return out.select(F.col("e.id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word",
                      "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                      F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
