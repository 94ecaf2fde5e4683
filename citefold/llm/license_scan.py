"""License notices by diagonal voting, in DataFrame functions only.

Hashes of all rolling word 3-grams of the documents are joined to the positions where they stand in a fixed table of
notices. Each match votes for the diagonal (place in the document minus place in the notice); votes on neighbouring
diagonals belong to one span with words added or left out. Spans with enough votes are verified against the words of
the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citefold.session import stage

GRAM = 3
NEAR = 3           # diagonals apart that still are one span
VOTES = 0.6        # share of a notice's 3-grams that a span needs
WORDS = 0.8        # share of a notice's distinct words that a verified span holds
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (label, base phrase or not, words of the notice).
NOTICES = (
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files"),
    ("apache-2", False, "you may not use this file except in compliance with the license you may obtain a copy of the "
                        "license at http www apache org licenses license 2 0"),
    ("gpl-3", False, "under the gnu general public license version 3"),
    ("gpl", False, "you can redistribute it and or modify it under the terms of the gnu general public license as "
                   "published by the free software foundation"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted "
                   "provided that the following conditions are met"),
    ("cc-by", False, "licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2", False, "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _notices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, notice, at) and (notice, label, base, expected words, grams); both as large as NOTICES."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, label, base, text.split()) for i, (label, base, text) in enumerate(NOTICES)],
                                  "notice int, label string, base boolean, expected array<string>")
    table = table.withColumn("grams", F.size("expected") - (GRAM - 1))
    grams = table.select("notice", F.posexplode(_grams("expected")).alias("at", "gram"))
    return grams, table


def _grams(column: str) -> Column:
    """Hash of the 3-gram at each place; the last two places hold shorter ones, which match nothing."""
    w = F.col(column)
    every = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(every, F.lit(1), F.greatest(F.size(w) - (GRAM - 1), F.lit(0)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    Words are runs of lower-cased (A-Z) letters, digits and characters beyond ASCII. A base notice counts at every place
    where its words stand consecutively; first_word and last_word are the least and greatest such place. Other notices
    count where a verified span holds most of them, whatever was added or left out. score is the best share of a
    notice's words found (0 without any). A null or empty text has no words and no label; rows may repeat and share
    doc_ids; other columns are ignored; an empty table gives no rows.
    """
    grams, notices = _notices(docs)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    read = rows.select("doc_id", "k", words_of(F.col("text")).alias("w"))
    placed = read.select("doc_id", "k", F.posexplode(_grams("w")).alias("pos", "gram"))
    votes = placed.join(F.broadcast(grams), "gram").select("doc_id", "k", "notice", "at", (F.col("pos") - F.col("at")).alias("d"))
    diagonals = votes.groupBy("doc_id", "k", "notice", "d").agg(F.collect_set("at").alias("at"))  # as long as a notice
    line = Window.partitionBy("doc_id", "k", "notice").orderBy("d")
    chained = diagonals.withColumn("new", (F.col("d") - F.lag("d").over(line) > NEAR).cast("int")).withColumn(
        "span", F.sum(F.coalesce("new", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = (chained.groupBy("doc_id", "k", "notice", "span")
             .agg(F.min(F.col("d") + F.array_min("at")).alias("start"), F.max(F.col("d") + F.array_max("at")).alias("stop"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"),
                  F.array_sort(F.collect_list(F.struct("d", F.size("at").alias("n")))).alias("diagonals"))
             .join(F.broadcast(notices), "notice"))
    strong = stage(spans.filter((F.col("votes") >= VOTES * F.col("grams"))
                                | (F.col("base") & F.exists("diagonals", lambda x: x.n == F.col("grams"))))
                   .groupBy("doc_id", "k").agg(F.collect_list(F.struct(
                       "label", "base", "expected", "grams", "start", "stop", "diagonals")).alias("spans")), "license-spans")
    # the words of documents with a strong span are read again to verify it
    same = rows.doc_id.eqNullSafe(strong.doc_id) & rows.k.eqNullSafe(strong.k)
    again = rows.join(strong.select("doc_id", "k", "spans"), same).select(
        rows.doc_id, rows.k, words_of(F.col("text")).alias("w"), "spans").dropDuplicates(["doc_id", "k"])
    opened = again.select("doc_id", "k", "w", F.posexplode("spans").alias("n", "s")).select("doc_id", "k", "w", "s.*")
    places = F.filter(F.transform("diagonals", lambda x: F.when(
        (x.n == F.col("grams")) & (F.slice("w", F.greatest(x.d, F.lit(0)) + 1, F.size("expected")) == F.col("expected")), x.d)), lambda x: x.isNotNull())
    span = F.slice("w", F.col("start") + 1, F.col("stop") - F.col("start") + GRAM)
    share = F.size(F.array_intersect("expected", span)) / F.size(F.array_distinct("expected"))
    judged = (opened.withColumn("starts", places)
              .withColumn("share", F.round(share, 6))
              .withColumn("own", ~F.col("base") & (F.col("share") >= WORDS))
              .select("doc_id", "k", "label", F.when(F.col("base"), F.col("starts")).otherwise(F.array().cast("array<int>")).alias("starts"),
                      "share", "own"))
    found = (judged.groupBy("doc_id", "k").agg(
        F.sum(F.size("starts")).cast("long").alias("n_base"),
        F.min(F.array_min("starts")).cast("long").alias("first_word"), F.max(F.array_max("starts")).cast("long").alias("last_word"),
        F.collect_set(F.when(F.size("starts") > 0, F.col("label"))).alias("base"),
        F.collect_set(F.when((F.size("starts") > 0) | F.col("own"), F.col("label"))).alias("all"),
        F.max(F.when((F.size("starts") > 0) | F.col("own"), F.col("share"))).alias("score")))
    counted = read.select("doc_id", "k", F.size("w").cast("long").alias("n_words"))
    match = counted.doc_id.eqNullSafe(found.doc_id) & counted.k.eqNullSafe(found.k)
    none = F.array().cast("array<string>")
    return counted.join(found, match, "left").select(
        counted.doc_id, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.coalesce("all", none)), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
