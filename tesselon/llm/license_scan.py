"""License scans by diagonal voting: word k-gram hashes joined with template positions, in DataFrame operations only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselon.llm._shared import store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals at most so far apart belong to one alignment: words were put in or left out between them.
NEIGHBOUR = 2
#: Distinct grams of the templates up to which grams are sieved by a list of them before they are exploded.
MOST_SIEVED = 20_000
#: Share of a template's grams that an alignment must hold.
LEAST_COVERAGE = 0.6

#: The phrases that count wherever they stand word for word, and their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Sentences of common notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
)


def template_grams(phrases=BASE_PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, int, int, tuple[str, ...]]]:
    """(template, label, base, grams in the template, position, gram)."""
    rows = []
    for i, (label, text) in enumerate((*phrases, *notices)):
        words = text.split()
        n = len(words) - GRAM + 1
        if n < 1:
            raise ValueError(f"a template needs {GRAM} words: {text}")
        rows += [(i, label, i < len(phrases), n, k, tuple(words[k : k + GRAM])) for k in range(n)]
    return rows


def rolling(words: list[F.Column]) -> F.Column:
    """Hash of a gram, from the hash of all its words but the last and that one."""
    out = F.xxhash64(words[0])
    for w in words[1:]:
        out = F.xxhash64(out, w)
    return out


def _templates(spark: SparkSession, grams: list[tuple]) -> DataFrame:
    """The grams' rows with their hashes, made from literals; words hold no character that SQL would have to escape."""
    rows = ", ".join(f"({i}, '{label}', {str(base).lower()}, {n}, {k}, '{' '.join(gram)}')" for i, label, base, n, k, gram in grams)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, base, grams, place, words)")
    words = F.split("words", " ")
    return table.select("template", "label", "base", "grams", "place", rolling([words[j] for j in range(GRAM)]).alias("gram"))


def lower_ascii(text: F.Column) -> F.Column:
    """A-Z in lower case and nothing else changed; a text of ASCII only takes the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def gram_hashes(words: F.Column) -> F.Column:
    """Rolling hashes of the words' grams. Each step reads two arrays side by side: no element is sought by its place."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for j in range(1, GRAM):
        hashes = F.zip_with(hashes, F.slice(words, j + 1, F.greatest(F.size(words), F.lit(1))), lambda h, w: F.xxhash64(h, w))
    return F.slice(hashes, 1, F.greatest(F.size(words) - F.lit(GRAM - 1), F.lit(0)))


def scan_licenses(docs: DataFrame, phrases=BASE_PHRASES, notices=NOTICES, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. Every
    rolling gram of three words is joined with the templates' grams; a match votes for the diagonal (place
    in the text less place in the template). A phrase stands where one diagonal has all its grams: n_base
    counts these places, first_word and last_word are their smallest and largest starts. For the notices,
    of any length, votes of diagonals at most two apart are merged, and the span is kept if it holds at
    least 60 % of the notice's grams and no better span shares a word with it: better is the larger share, of equal ones
    the more grams, then the earlier template, then the later place. So one sentence gets the label of the notice that it follows best. labels has the labels of both kinds, distinct, sorted, comma-joined;
    spans has (label, first, last) word places; score is the largest share of a template's grams that was
    found, 1 where a phrase stands. Null, empty and shorter texts have no places: counts 0, first and last
    null, labels empty, score 0. A text of any length is scanned whole, in time that grows with it. Each
    row gives a row, repeated ids too. An empty table gives no rows. Other columns are not read.

    Scale: the template table is a constant of this module or a caller's list, made from literals, and
    the only thing broadcast. Grams that no template has are sieved out before the rest is exploded and
    joined; what is shuffled is one row for each document and each voted diagonal, and one for each word of the spans that
    contest. Matched grams are stored before the first shuffle, so that row numbers stay when an executor is lost.
    """
    spark = docs.sparkSession
    grams = template_grams(phrases, notices)
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(column), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), words.alias("_words"))
    rows = rows.select("_row", "_id", F.size("_words").cast("long").alias("n_words"), gram_hashes(F.col("_words")).alias("_grams"))
    distinct = sorted({g for *_, g in grams})
    placed = F.transform("_grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram")))
    if len(distinct) <= MOST_SIEVED:
        placed = F.filter(placed, lambda p: p["gram"].isin([rolling([F.lit(w) for w in g]) for g in distinct]))
    rows = rows.select("_row", "_id", "n_words", F.explode_outer(placed).alias("_p")).select("_row", "_id", "n_words", F.col("_p.at").alias("_at"), F.col("_p.gram").alias("gram"))
    rows = store(rows)
    # Left, so that documents without a match stay.
    votes = rows.join(F.broadcast(_templates(spark, grams)), "gram", "left")
    diagonals = votes.groupBy("_row", "_id", "n_words", "template", "label", "base", "grams", (F.col("_at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("_at").alias("first"), F.max("_at").alias("last")
    )
    in_doc = Window.partitionBy("_row", "template").orderBy("diagonal")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(in_doc) > NEIGHBOUR).cast("int"), F.lit(0))
    merged = diagonals.withColumn("_gap", F.when(F.col("base"), 1).otherwise(gap)).withColumn("_group", F.sum("_gap").over(in_doc))
    spans = merged.groupBy("_row", "_id", "n_words", "template", "label", "base", "grams", "_group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last")
    )
    share = F.col("held") / F.col("grams")
    stands = F.coalesce(F.col("base") & (share == 1), F.lit(False))
    notice = F.coalesce(~F.col("base") & (share >= LEAST_COVERAGE), F.lit(False))
    # Spans that share a word contest: each word of theirs knows the best one over it. The others stand alone.
    rank = F.struct(share.alias("share"), "held", (-F.col("template")).alias("template"), "first")
    words_of = F.when(notice, F.sequence("first", "last")).otherwise(F.array(F.coalesce(-1 - F.col("first"), F.lit(-1))))
    contest = spans.select("*", notice.alias("_notice"), F.explode(words_of).alias("_word"))
    best = F.max(rank).over(Window.partitionBy("_row", "_word"))
    contest = contest.select("*", (F.col("_notice") & (best > rank)).alias("_loses"))
    spans = contest.groupBy("_row", "_id", "n_words", "template", "label", "base", "grams", "_group", "held", "first", "last").agg(F.max("_loses").alias("_loses"))
    good = stands | (notice & ~F.col("_loses"))
    joined = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    place = F.when(good, F.struct("label", "first", "last"))
    out = spans.groupBy("_row", "_id", "n_words").agg(
        F.count(F.when(stands, 1)).alias("n_base"),
        F.min(F.when(stands, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(stands, F.col("first"))).cast("long").alias("last_word"),
        joined(stands).alias("base_labels"),
        joined(good).alias("labels"),
        F.coalesce(F.max(F.when(stands | ~F.col("base"), share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(place)).alias("spans"),
    )
    return out.withColumnRenamed("_id", id_column).select(id_column, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def digest(docs: DataFrame, **options) -> DataFrame:
    return scan_licenses(docs.select("doc_id", "text"), **options).drop("spans")
