"""License notices in documents, by voting of word k-grams along diagonals; DataFrame functions only.

Rolling k-gram hashes of all words of a document meet those of the templates in a join. A meeting votes for a diagonal, the
word's place less the template's. Votes are added up by document, template and diagonal; diagonals of a long template that
lie close to each other, as words put in or left out make them, are one span. Spans with the votes that a match must have are
then compared with the template word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Words of a gram: of phrases, and of all other templates.
SHORT, LONG = 2, 3
#: Templates of so many words may differ from the text; those of fewer must stand there word by word.
LOOSE = 20
#: Share of its words that a loose template needs, and how far apart two diagonals of one span may lie.
SHARE, SLACK = 0.8, 3
#: Keys (16 bytes each) of texts to verify that are broadcast at most; beyond, the join is left to Spark.
BROADCAST_KEYS = 1 << 20

# Phrases of the contract and texts of public licenses.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    ("agpl", "GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null: none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # the same letters change either way where all are ASCII, only faster
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))
    return F.array_remove(F.split(lower, _BETWEEN), "")


def _grams(words: Column, k: int) -> Column:
    """A hash of every k words in a row."""
    last = F.size(words) - k
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, base, label, own, size, k, loose): the texts as words. A text of fewer words than a gram is refused."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(i < len(phrases)).alias("base"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate([*phrases, *notices])]
    told = spark.range(1).select(F.inline(F.array(*rows))).withColumn("own", words_of(F.col("text")))
    size = F.size("own")
    k = F.when(F.col("base"), SHORT).otherwise(LONG)
    sized = told.select("template", "base", "label", "own", size.alias("size"), k.alias("k"), (~F.col("base") & (size >= LOOSE)).alias("loose"))
    return sized.withColumn("k", F.when(F.col("size") >= F.col("k"), F.col("k")).otherwise(F.raise_error(F.concat(F.lit("too short: "), F.col("label")))))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row a document.

    A base phrase counts at every place where its words stand in a row; labels are distinct, sorted and comma-joined, of the
    base phrases and of all templates. A loose template matches where SHARE of its words stand on close diagonals, in place;
    by the q-gram lemma the votes asked for lose no such match by replaced words. ``score`` is the greatest share of words of a
    template that a document was found to hold (0: nothing to verify); ``spans`` lists (label, start, end, share) of what
    matched. Null and empty texts have no words; equal rows give equal rows, as many; a null doc_id is a value like others.
    """
    spark = docs.sparkSession
    known = templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    # of constants: some hundred rows, whatever the documents
    grams = known.select("template", "k", F.posexplode(_grams(F.col("own"), SHORT)).alias("at", "gram")).where(F.col("k") == SHORT).union(
        known.select("template", "k", F.posexplode(_grams(F.col("own"), LONG)).alias("at", "gram")).where(F.col("k") == LONG)
    )
    # 128 bits of a row's id and text; equal rows share them
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]
    read = docs.select("doc_id", *keys, words_of(F.col("text")).alias("words")).select("doc_id", "k1", "k2", F.size("words").alias("n_words"), _grams(F.col("words"), SHORT).alias("short"), _grams(F.col("words"), LONG).alias("long"))
    # place 0 is the document itself, so that one without a hit stays
    flat = read.select("doc_id", "k1", "k2", "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "short", "long")).alias("p", "gram"))
    shorts = F.greatest(F.col("n_words") - (SHORT - 1), F.lit(0))
    is_short = F.col("p") <= shorts
    placed = flat.select("doc_id", "k1", "k2", "n_words", "p", F.when(F.col("p") > 0, F.col("gram")).alias("gram"), F.when(is_short, SHORT).otherwise(LONG).alias("k"), F.when(is_short, F.col("p") - 1).otherwise(F.col("p") - 1 - shorts).alias("place"))
    met = placed.join(F.broadcast(grams), ["gram", "k"], "left").where("p = 0 or template is not null")
    voted = met.groupBy("doc_id", "k1", "k2", "n_words", "template", (F.col("place") - F.col("at")).alias("diagonal"))
    votes = table(voted.agg(F.count("*").alias("n"), F.collect_set("at").alias("at")), "license-votes")
    rows = votes.where("template is null").select("doc_id", "k1", "k2", "n_words", F.col("n").alias("copies"))

    sizes = F.broadcast(known.select("template", "base", "label", "size", "k", "loose"))
    hits = votes.where("template is not null").select("k1", "k2", "template", "diagonal", "at").join(sizes, "template")
    exact = hits.where(~F.col("loose") & (F.size("at") == F.col("size") - F.col("k") + 1)).select("k1", "k2", "template", "size", F.array("diagonal").alias("diagonals"))
    order = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    runs = hits.where("loose").withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order)).groupBy("k1", "k2", "template", "size", "run")
    merged = runs.agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"))
    needed = F.col("size") - (LONG - 1) - LONG * F.floor(F.col("size") * (1 - SHARE) + 1e-9)
    spans = exact.union(merged.where(F.col("n") >= F.greatest(needed, F.lit(1))).select("k1", "k2", "template", "size", "diagonals"))
    asked = table(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "size", "diagonals")).alias("asked")), "license-spans")

    texts = docs.select(*keys, "text")
    if asked.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(asked.select("k1", "k2")), ["k1", "k2"], "left_semi")
    held = texts.join(asked, ["k1", "k2"]).select("k1", "k2", "asked", words_of(F.col("text")).alias("words"))

    def cut(x: Column) -> Column:
        """The words that a span may touch, none before the text's first."""
        first, last = F.array_min(x["diagonals"]), F.array_max(x["diagonals"])
        start = F.greatest(first, F.lit(0))
        return F.struct(x["template"].alias("template"), x["diagonals"].alias("diagonals"), start.alias("start"), F.slice("words", start + 1, F.greatest(last + x["size"] - start, F.lit(0))).alias("there"))

    each = held.select("k1", "k2", F.inline(F.transform("asked", cut))).join(F.broadcast(known), "template")
    place = lambda t, d: t + d - F.col("start")
    same = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda t: F.exists("diagonals", lambda d: (place(t, d) >= 0) & F.coalesce(F.get("there", F.greatest(place(t, d), F.lit(0))) == F.get("own", t), F.lit(False))))
    shared = each.withColumn("share", F.size(same) / F.col("size"))
    good = F.col("share") >= F.when(F.col("loose"), SHARE).otherwise(1.0)
    base, first = good & F.col("base"), F.array_min("diagonals").cast("long")
    span = F.struct("label", F.col("start").cast("long").alias("start"), (F.col("start") + F.size("there")).cast("long").alias("end"), "share")
    found = shared.groupBy("k1", "k2").agg(
        # places of equal rows are the same ones
        F.count_distinct(F.when(base, F.struct("template", first.alias("at")))).alias("n_base"), F.min(F.when(base, first)).alias("first_word"), F.max(F.when(base, first)).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"), F.sort_array(F.collect_set(F.when(good, span))).alias("spans"),
    )
    every = rows.join(found, ["k1", "k2"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    blank = F.array().cast("array<struct<label:string,start:bigint,end:bigint,share:double>>")
    return every.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", blank).alias("spans"),
    )
