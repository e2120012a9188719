"""License scan by diagonal voting.

Every rolling window of 3 words of every document is hashed and joined with the windows of
the license templates. A hit at word ``pos`` of a document and ``place`` of a template
votes for the diagonal ``pos - place``: a notice that was copied word for word has all its
votes on one. An inserted or missing word moves the rest to a neighbouring diagonal, so
diagonals up to ``GAP`` words apart whose votes go on in the template are merged. A merged
span is verified: it must cover ``COVERAGE`` of the template's words, or ``LONG`` words of a
long one, and be no longer than that allows. Of spans over the same words the one that
covers most of its template counts, so a notice is not taken for its shorter relatives.

Beside it, stated phrases are found wherever their words stand; their labels always stay.

All hits carry the document's key and diagonal through the grouping, so a license line in
a third of all documents, or thousands of times in one, spreads like any other rows; the
templates are constants and sent to all executors.

Defined results: a null or empty text has no words, no labels (empty text) and score 0;
texts shorter than a window can only hold phrases; a repeated row gets a row of its own;
a null id is an id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text_basics import bind
from .common import salted_lookup

# A word is a run of ASCII digits, lower-case letters and anything beyond ASCII;
# what stands between words of a lower-cased text; a word in any case.
GAP_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KELVIN, KELVIN_KEPT = "\u212a", "\ue00b"
WINDOW = 3
GAP = 4
COVERAGE, LONG = 0.75, 40
PHRASE_SCORE = 0.5  # of a text that holds a phrase and no verified span

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Statements and notices of licenses as their owners publish them, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
     The above copyright notice and this permission notice shall be included in all copies or substantial portions of
     the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
     NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
     EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
     ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
     DEALINGS IN THE SOFTWARE."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
     Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
     on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
     the specific language governing permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
     Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
     any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
     without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
     Public License for more details."""),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
     General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
     your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
     WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
     Lesser General Public License for more details."""),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3"),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
     option) any later version."""),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
     was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
     the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
     list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
     copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
     provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
     publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
     any purpose, commercial or non-commercial, and by any means."""),
    ("cc0", "Licensed under CC0 1.0 Universal"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
]


def normal(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with single spaces between; empty for a null."""
    # ``lower`` is right for A-Z; the only other character that it would turn into ASCII is kept
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(KELVIN_KEPT)))
    return F.btrim(F.regexp_replace(lowered, GAP_BETWEEN, " "))


def templates(spark: SparkSession, named: list[tuple[str, str]]) -> DataFrame:
    """``template, label, size, place, words``: each window of each template."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(named)]
    listed = spark.range(1).select(F.inline(F.array(*rows))).select("template", "label", normal(F.col("text")).alias("normal"))
    sized = listed.withColumn("size", F.size(F.split("normal", " ")))
    return windows(sized, ["template", "label", "size"], "place")


def windows(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``keys``, ``place`` and ``words`` of each window of the words in ``normal``: a pattern with
    a look-ahead finds the overlapping windows at one pass."""
    pattern = f"(?=({' '.join(['[^ ]+'] * WINDOW)}))[^ ]+"
    return rows.select(*keys, F.posexplode(F.regexp_extract_all("normal", F.lit(pattern), F.lit(1))).alias(place, "words"))


def spans(documents: DataFrame, keys: list[str], named: list[tuple[str, str]] | None = None) -> DataFrame:
    """``keys, label, template, first, last, covered, size``: verified spans of ``documents``
    (``keys``, ``normal``), overlapping ones reduced to the best."""
    known = templates(documents.sparkSession, named or TEMPLATES)
    known = known.select("template", "label", "size", "place", F.col("words").alias("theirs"), F.xxhash64("words").alias("hash"))
    mine = windows(documents, keys, "pos").withColumn("hash", F.xxhash64("words"))
    hits = mine.join(F.broadcast(known), "hash").where(F.col("words") == F.col("theirs"))
    of = [*keys, "template", "label", "size"]
    diagonals = hits.groupBy(*of, (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    # a span begins at a diagonal without a neighbour before it
    order = Window.partitionBy(*of).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > GAP
    begins = diagonals.withColumn("begins", F.coalesce(apart, F.lit(True)).cast("int"))
    parted = begins.withColumn("span", F.sum("begins").over(order))
    merged = parted.groupBy(*of, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"),
        (F.max("last") + (WINDOW - 1)).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (WINDOW - 1))))))
    sized = merged.select(*of, "first", "last", covered.alias("covered"))
    length = F.col("last") - F.col("first") + 1
    enough = (F.col("covered") >= COVERAGE * F.col("size")) | (F.col("covered") >= LONG)
    verified = sized.where(enough & (F.col("covered") >= COVERAGE * length))
    # spans over the same words: a new group begins behind the end of all before it
    by_place = Window.partitionBy(*keys).orderBy("first", "last", "template")
    reached = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    islands = verified.withColumn("opens", (F.col("first") > F.coalesce(reached, F.lit(-1))).cast("int"))
    islands = islands.withColumn("island", F.sum("opens").over(by_place))
    rank = F.rank().over(Window.partitionBy(*keys, "island").orderBy(F.desc("covered"), "size"))
    best = islands.withColumn("rank", rank).where("rank = 1")
    return best.select(*keys, "label", "template", "first", "last", "covered", "size")


def phrase_places(held: Column, phrases: dict[str, str]) -> Column:
    """Places ``(at, label)`` at which the words of a phrase stand one after another in ``held``,
    which is worked out once."""

    def places(words: Column, parts: list[str], label: str) -> Column:
        phrase, many = F.array(*[F.lit(p) for p in parts]), len(parts)
        every = F.sequence(F.lit(0), F.greatest(F.size(words) - many, F.lit(0)))
        starts = F.filter(every, lambda i: F.slice(words, i + 1, F.lit(many)) == phrase)
        return F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

    return bind(held, lambda words: F.concat(*[places(words, phrase.split(), label) for phrase, label in phrases.items()]))


def scan(documents: DataFrame, named: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each
    row of ``documents`` (``doc_id, text``); labels sorted and joined by commas."""
    phrases = phrases or PHRASES
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # words that every phrase ends with, so that most texts are done at a look
    ends = sorted({p.split()[-1] for p in phrases})
    lowered = F.lower("text")
    some = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(e)) for e in ends])
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    found = phrase_places(F.split(normal(F.col("text")), " "), phrases)
    placed = keyed.select(
        "doc_id", "text_hash", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("bigint").alias("n_words"),
        F.when(some, found).otherwise(none).alias("places"),
    )
    based = placed.select(
        "doc_id", "text_hash", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.at").alias("first_word"), F.array_max("places.at").alias("last_word"),
        F.array_sort(F.array_distinct("places.label")).alias("base"),
    )
    # equal rows have equal spans: they are one group, which counts each hit once
    texts = keyed.select("doc_id", "text_hash", normal(F.col("text")).alias("normal"))
    found = spans(texts, ["doc_id", "text_hash"], named).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("more"), F.max(F.col("covered") / F.col("size")).alias("best")
    )
    both = salted_lookup(based, found, ["doc_id", "text_hash"], F.col("n_words"), 8)
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    phrase = F.when(F.col("n_base") > 0, PHRASE_SCORE).otherwise(0.0)
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.greatest(phrase, F.coalesce("best", F.lit(0.0))).alias("score"),
    )
