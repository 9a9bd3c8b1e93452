"""License notices: phrases, and an exact set-similarity join of text blocks with notice templates."""
from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.session import written

# Phrases whose words stand one after another, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Words of public license notices, by label. A block of text carries a label if it holds enough of them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files, to deal in the Software without restriction, including without limitation the rights to "
           "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-line": "Released under the MIT License",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
           "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
           "distributed with this file, You can obtain one at",
    "cc": "Licensed under CC BY-NC 4.0",
    "cc-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
# The share of a template's distinct words that a block must hold; one of few words must be there in full.
SHARE, FEW = 0.8, 12
# These words must stand within this many times the template's length, repeats included.
STRETCH = 2

_PART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words in order, A-Z lower-cased; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _PART), lambda w: w != "")


def _places(words: Column) -> Column:
    """array<struct<at, label>> of the phrases' places; every phrase ends in the word `license`."""
    def here(w: Column, i: Column) -> Column:
        found = []
        for phrase, name in PHRASES.items():
            before = phrase.split()[:-1]
            start = i - len(before)
            hit = reduce(and_, [F.get(words, start + k) == word for k, word in enumerate(before)])
            found.append(F.when(hit, F.struct(start.cast("long").alias("at"), F.lit(name).alias("label"))))
        return F.when(w == "license", F.coalesce(*found))

    return F.filter(F.transform(words, here), lambda p: p.isNotNull())


def needed(n: int, share: float = SHARE) -> int:
    """How many of a template's n distinct words a block must hold."""
    return n if n <= FEW else math.ceil(n * share)


def templates(spark: SparkSession) -> DataFrame:
    """(label, words, reach) of the templates: distinct words, and within how many words of a block they must stand."""
    rows = spark.createDataFrame(list(TEMPLATES.items()), "name string, text string")
    words = license_words(F.col("text"))
    return rows.select("name", F.substring_index("name", "-", 1).alias("label"), F.array_distinct(words).alias("words"),
                       (F.size(words) * STRETCH).alias("reach"))


def scan_licenses(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    Base labels come from the places of PHRASES in the whole word sequence. The method's labels come from blocks
    (paragraphs: what blank lines part): a block gets a template's label if it holds at least `share` of the template's
    distinct words (all of them if they are few) within `reach` words in a row. Found exactly, without comparing all pairs:
    the template words are put in order of their frequency in the whole corpus, rarest first, and a block is the ordered set
    of those it holds. A pair needs a common word among the first n - need + 1 of the template (prefix), need words in the
    block (length), and need words from the first common one on in either (position). Pairs that are left are counted in
    full, then in each stretch of `reach` words that begins with a word of the template. score is the largest share held in
    a stretch by any block that qualifies, 1 if there is only a base label, else 0.

    Only the templates' few words are counted over the corpus, summed per task. Null and empty texts have no words and no
    labels; rows of equal id and text get equal results; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    given = templates(spark)
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    vocabulary = sorted({w for (w,) in given.select(F.explode("words")).collect()})  # the templates' words, a constant
    seen = rows.select(F.explode(F.array_intersect(license_words(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    often = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row per template word
    ordered = []
    for r in given.collect():
        words = sorted(r["words"], key=lambda w: (often.get(w, 0), w))
        need = needed(len(words), share)
        ordered += [(r["label"], words, need, r["reach"], place, word) for place, word in enumerate(words[:len(words) - need + 1])]
    prefix = spark.createDataFrame(ordered, "label string, template array<string>, need int, reach int, place int, word string")
    starts = sorted({r[5] for r in ordered})
    order = F.array(*[F.lit(w) for w in sorted(vocabulary, key=lambda w: (often.get(w, 0), w))])

    words = license_words(F.col("text"))
    base = rows.select("doc_id", "hash", words.alias("words"))
    base = base.select("doc_id", "hash", F.size("words").cast("long").alias("n_words"),
                       F.when(F.array_contains("words", "license"), _places(F.col("words"))).alias("places"))
    any_start = F.exists(F.split(F.translate("text", _UPPER, _LOWER), _PART), lambda w: w.isin(starts))
    blocks = (rows.where(any_start).select("doc_id", "hash", F.explode(F.split("text", r"\n[\x20\x09\x0B-\x0D]*\n")).alias("block"))
              .select("doc_id", "hash", license_words(F.col("block")).alias("all")))
    blocks = blocks.withColumn("own", F.array_intersect(order, "all"))
    candidates = (blocks.select("*", F.posexplode("own").alias("at", "word")).where(F.col("word").isin(starts)).join(prefix, "word")
                  .where((F.size("own") - F.col("at") >= F.col("need")) & (F.size("template") - F.col("place") >= F.col("need"))))
    # a pair meets at each prefix word it shares; the first in order stands for it
    first = F.filter("template", lambda w: F.array_contains("own", w))[0] == F.col("word")
    pairs = candidates.where(first).where(F.size(F.array_intersect("own", "template")) >= F.col("need"))
    begins = F.filter(F.transform("all", lambda w, i: F.when(F.array_contains("template", w), i + 1)), lambda i: i.isNotNull())
    held = F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect(F.slice("all", i, F.col("reach")), "template"))))
    hits = (pairs.withColumn("held", held).where("held >= need")
            .select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "label", (F.col("held") / F.size("template")).alias("share")))
    found = written(hits.groupBy("_id", "_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "notices")
    result = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("hash").eqNullSafe(F.col("_hash")), "left")
    places = F.coalesce("places", F.array().cast("array<struct<at:long,label:string>>"))
    base_labels = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>"))))
    return result.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(F.transform(places, lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["at"])).alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce("share", F.when(F.size(places) > 0, 1.0).otherwise(0.0)).alias("score"))


def _sql_words(text: str) -> str:
    return (f"list_filter(string_split_regex(translate({text}, '{_UPPER}', '{_LOWER}'), "
            "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")


def oracle() -> str:
    """DuckDB SQL for the rows of `scan_licenses`."""
    hits = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts))
        hits.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {same}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    notices = ", ".join("('{}', '{}')".format(name.split("-")[0], text.replace("'", "''")) for name, text in TEMPLATES.items())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_sql_words("coalesce(text, '')")} AS w FROM documents),
base AS (SELECT *, list_concat({hits[0]}, list_concat({hits[1]}, {hits[2]})) AS p FROM docs),
notices AS (SELECT label, list_distinct(w) AS words, len(list_distinct(w)) AS n, {STRETCH} * len(w) AS reach
            FROM (SELECT label, {_sql_words("text")} AS w FROM (VALUES {notices}) AS t(label, text))),
blocks AS (SELECT doc_id, unnest(string_split_regex(text, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n')) AS block FROM docs),
own AS (SELECT doc_id, {_sql_words("block")} AS w FROM blocks),
near AS (SELECT doc_id, label, n, reach, w, words FROM own o, notices
         WHERE len(list_intersect(list_distinct(w), words)) >= CASE WHEN n <= {FEW} THEN n ELSE ceil(n * {SHARE}) END),
held AS (SELECT doc_id, label, n, list_max(list_transform(range(1, len(w) + 1),
         lambda i: len(list_intersect(list_distinct(w[i:i + reach - 1]), words)))) AS held FROM near),
more AS (SELECT doc_id, list(label) AS labels, max(held::DOUBLE / n) AS share FROM held
         WHERE held >= CASE WHEN n <= {FEW} THEN n ELSE ceil(n * {SHARE}) END GROUP BY doc_id)
SELECT b.doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(list_transform(p, lambda x: x.at))::BIGINT AS first_word,
       list_max(list_transform(p, lambda x: x.at))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
       coalesce(share, CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM base b LEFT JOIN more m ON b.doc_id = m.doc_id
"""
