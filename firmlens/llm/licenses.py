"""License scans by diagonal voting.

1. Every window of k words of every text is hashed; windows whose hash a template has are
   kept with their place. Only DataFrame functions, in one pass over the texts.
2. They are joined to the places of the same window in the templates. Each match votes for
   the diagonal (place in the text less place in the template), and votes are counted.
3. Neighbouring diagonals are merged, as added or missing words shift them.
4. Spans with enough votes are verified on the words themselves, place by place.

Phrases are templates that must stand word for word on one diagonal. Only rows with a
matching window go on after step 1, and of these the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.llm.common import stored

#: What a word is, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Sentences of public license notices and their labels.
NOTICES = [
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"),
]
#: Words of a window, or a whole template of fewer words.
K = 4
#: Of a notice's words, this share must stand in their places.
MIN_SHARE = 0.8
#: Up to this many different windows of all templates, others are dropped before the join, and the templates are broadcast.
MAX_LISTED = 20_000


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), 1)


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """(tid, label, exact, k, words): one row per template; k is at most its number of words."""
    rows = [(label, True, text) for label, text in phrases] + [(label, False, text) for label, text in notices]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tid int, label string, exact boolean, text string")
    df = df.select("tid", "label", "exact", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return df.select("tid", "label", "exact", F.least(F.lit(k), F.size("words")).alias("k"), "words")


def window_hash(words: str, at: str, k: int) -> str:
    return "xxhash64(" + ", ".join(f"{words}[{at} + {j}]" for j in range(k)) + ")"


def _windows(words: str, k: int) -> str:
    """SQL of an array of (at, k, h): all windows of k words."""
    return f"if(size({words}) < {k}, array(), transform(sequence(0, size({words}) - {k}), i -> struct(i as at, {k} as k, {window_hash(words, 'i', k)} as h)))"


def grams(found: DataFrame) -> DataFrame:
    """(tid, k, h, place): the windows of templates."""
    sizes = [r.k for r in found.select("k").distinct().collect()]
    per_size = [found.where(F.col("k") == k).select("tid", F.explode(F.expr(_windows("words", k))).alias("w")).select("tid", "w.k", "w.h", F.col("w.at").alias("place")) for k in sizes]
    out = per_size[0]
    for df in per_size[1:]:
        out = out.unionByName(df)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, k: int = K, max_listed: int = MAX_LISTED) -> DataFrame:
    """(key, n_words, spans): one row per row of `docs`; spans array<struct<start, end, label, exact, share>> by start, end, label.

    Words are runs of digits, a-z (A-Z counts as a-z) and characters from U+0080 on; a span
    holds words start .. end - 1. A span of a phrase has it word for word. A span of a
    notice has a quarter of its windows at least, and `share` of its words in their places;
    `labels_of` takes those with enough. Null and empty texts have no words and no spans.
    Repeated and null keys are rows of their own; other columns are not read.
    """
    spark = docs.sparkSession
    known = stored(templates(spark, phrases, notices, k), "templates")
    places = stored(grams(known), "template_windows")
    sizes = sorted(r.k for r in known.select("k").distinct().collect())
    listed = places.count() <= max_listed
    kept = []
    for size in sizes:
        hashes = ", ".join(f"{r.h}L" for r in places.where(F.col("k") == size).select("h").distinct().collect()) if listed else ""
        kept.append(f"filter({_windows('words', size)}, x -> x.h in ({hashes}))" if listed else _windows("words", size))
    narrow = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words")).withColumn("hits", F.expr(f"concat({', '.join(kept)})"))
    # Written with its row numbers, which a lost executor can then not change.
    rows = stored(
        narrow.select(F.monotonically_increasing_id().alias("row"), "key", F.size("words").cast("long").alias("n_words"), F.when(F.size("hits") > 0, F.col("words")).alias("words"), "hits"), "license_rows"
    )
    met = F.broadcast(places) if listed else places.hint("shuffle_merge")
    votes = rows.select("row", F.explode("hits").alias("x")).select("row", "x.*").join(met, ["k", "h"])
    by = votes.groupBy("row", "tid", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"))
    about = known.select("tid", "label", "exact", F.col("words").alias("t"), (F.size("words") - F.col("k") + 1).alias("windows"))
    diagonals = by.join(F.broadcast(about) if listed else about.hint("shuffle_merge"), "tid")
    over = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(over) > F.floor(F.size("t") / 8) + 1)
    merged = (
        diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(over))
        .groupBy("row", "tid", "span", "label", "exact", "t", "windows")
        .agg(F.sum("votes").alias("votes"), F.array_sort(F.collect_list("diagonal")).alias("on"))
        .where(F.when(F.col("exact"), F.col("votes") == F.col("windows")).otherwise(4 * F.col("votes") >= F.col("windows")))
    )
    candidates = merged.groupBy("row").agg(F.collect_list(F.struct("label", "exact", "t", "on")).alias("c"))
    checked = candidates.join(rows.where("words is not null").select("row", "words").hint("shuffle_merge"), "row").select("row", F.expr(VERIFY).alias("spans"))
    spans = stored(checked.select("row", F.expr("array_sort(filter(spans, s -> not s.exact or s.share = 1))").alias("spans")), "license_spans")
    out = rows.select("row", "key", "n_words").join(spans.hint("shuffle_merge"), "row", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start: long, end: long, label: string, exact: boolean, share: double>>)")).alias("spans"))


#: A candidate's places: where its words stand on one of its diagonals.
VERIFY = """transform(c, c -> struct(
    cast(greatest(0, c.on[0]) as long) as start, cast(least(size(words), element_at(c.on, -1) + size(c.t)) as long) as `end`, c.label as label, c.exact as exact,
    size(filter(sequence(0, size(c.t) - 1), i -> exists(c.on, d -> coalesce(get(words, d + i) = c.t[i], false)))) / size(c.t) as share))"""


def labels_of(spans: str = "spans", min_share: float = MIN_SHARE) -> Column:
    """The labels of spans of phrases and of notices with enough of their words: distinct, sorted, joined by commas."""
    return F.expr(f"array_join(array_sort(array_distinct(transform(filter({spans}, s -> s.share >= {min_share}), s -> s.label))), ',')")
