"""License scans by diagonal voting (DataFrame functions only).

Every word position of a text gives rolling hashes of 2 and 4 words.  A join
with the template table on these hashes makes votes (template, diagonal), the
diagonal being text position minus template position.  Votes are added up by
diagonal; for long templates neighbouring diagonals are merged (a word put in
or left out moves the rest by one), and a span counts once enough of the
template's k-grams vote for it.  Short phrases need all of theirs, which makes
a base hit exact; the join also compares the words, so no hash decides alone.

The template table is a parameter; up to ``MOST_BROADCAST`` rows (the given one
has some hundreds) it is broadcast, and the votes of a document are added up where it was read; only hits (and one row
for each document) are shuffled.

Defined cases: a null or empty text has no words, no place and score 0.  A
repeated row or doc_id is a document of its own.  A null doc_id is kept.  An
empty table gives no rows.  Labels are '' where nothing is found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import literal_table

# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Lines of public license texts and notices (lower case, words
# only), their labels, and the words that tell a line from others of its form
# (a k-gram with them must be found; '' for none).
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache"),
    ("you may not use this file except in compliance with the license", "apache-2.0", ""),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0",
     "version 3"),
    ("this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation", "gpl-notice",
     ""),
    ("released under the mit license", "mit-notice", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files to deal in the software without restriction",
     "mit-notice", ""),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met", "bsd-notice", ""),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0",
     "attribution"),
    ("the above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the software", "mit-notice", ""),
    ("the software is provided as is without warranty of any kind express or implied including "
     "but not limited to the warranties of merchantability fitness for a particular purpose and "
     "noninfringement in no event shall the authors or copyright holders be liable for any claim "
     "damages or other liability whether in an action of contract tort or otherwise arising from "
     "out of or in connection with the software or the use or other dealings in the software",
     "mit-notice", ""),
    ("redistributions of source code must retain the above copyright notice this list of "
     "conditions and the following disclaimer", "bsd-notice", ""),
    ("redistributions in binary form must reproduce the above copyright notice this list of "
     "conditions and the following disclaimer in the documentation and or other materials "
     "provided with the distribution", "bsd-notice", ""),
    ("neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written "
     "permission", "bsd-3-clause", ""),
    ("permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted provided that the above copyright notice and this permission "
     "notice appear in all copies", "isc", ""),
    ("this library is free software you can redistribute it and or modify it under the terms of "
     "the gnu lesser general public license as published by the free software foundation",
     "lgpl-notice", "lesser"),
    ("this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu affero general public license as published by the free software foundation",
     "agpl-notice", "affero"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy "
     "of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 "
     "0", "mpl-2.0", ""),
    ("this is free and unencumbered software released into the public domain anyone is free to "
     "copy modify publish use compile sell or distribute this software", "unlicense", ""),
    ("this software is provided as is without any express or implied warranty in no event will "
     "the authors be held liable for any damages arising from the use of this software", "zlib",
     ""),
    ("distributed under the boost software license version 1 0", "bsl-1.0", "boost"),
    ("this work is licensed under the creative commons attribution sharealike 4 0 international "
     "license", "cc-by-sa-4.0", "sharealike"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "sa"),
    ("to the extent possible under law the author has waived all copyright and related or "
     "neighboring rights to this work", "cc0-1.0", ""),
    ("this program and the accompanying materials are made available under the terms of the "
     "eclipse public license v1 0 which accompanies this distribution", "epl-notice", "eclipse"),
)
# License ids of SPDX-License-Identifier lines; found as a whole.
SPDX = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0",
        "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
        "Unlicense", "BSL-1.0", "Zlib", "EPL-1.0", "EPL-2.0", "0BSD")
KIND = ("label", "base", "exact", "grams", "least")  # of a template
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, LONG_GRAM = 2, 4
LONG_WORDS = 16     # a notice of fewer words votes with 2-grams
LEAST_SHARE = 0.6   # of a long notice's 4-grams
SHORT_SHARE = 0.5   # of a short notice's 2-grams: one changed word costs two
MOST_BROADCAST = 100_000  # template positions
DRIFT = 2           # diagonals further apart are not one span
GAP = 8             # words from one vote of a span to the next, at most


def template_rows(notices: Sequence[tuple[str, str, str]] = NOTICES) -> list[dict]:
    """One row for each position of a template: its next words.  Phrases, SPDX
    lines and short notices have 2-grams, long notices 4-grams."""
    spdx = [("spdx license identifier " + " ".join(x.lower().replace(".", "-").split("-")),
             x.lower(), "") for x in SPDX]
    templates = [(text, label, "", True, True) for text, label in PHRASES]
    templates += [(*t, False, True) for t in spdx] + [(*t, False, False) for t in notices]
    rows = []
    for k, (text, label, mark, base, exact) in enumerate(templates):
        words = text.split()
        n = GRAM if exact or len(words) < LONG_WORDS else LONG_GRAM
        for i in range(len(words) - n + 1):
            rows.append({"template": k, "label": label, "base": base, "exact": exact, "tpos": i,
                         "grams": len(words) - n + 1,
                         "least": LEAST_SHARE if n == LONG_GRAM else SHORT_SHARE,
                         "marked": set(mark.split()) <= set(words[i:i + n]),
                         **{f"t{j}": w for j, w in enumerate(words[i:i + n])}})
    return rows


def template_table(spark: SparkSession,
                   notices: Sequence[tuple[str, str, str]] = NOTICES) -> DataFrame:
    """``template_rows`` with their hashes; a hint to broadcast them while
    they are few."""
    rows = template_rows(notices)
    t = literal_table(spark, rows, "template int, label string, base boolean, exact boolean, "
                                   "tpos int, grams int, least double, marked boolean, t0 string, "
                                   "t1 string, t2 string, t3 string")
    t = t.withColumn("tkey", F.xxhash64("t0", "t1"))
    return F.broadcast(t) if len(rows) <= MOST_BROADCAST else t


def words_of(text: Column) -> Column:
    """The words of a text.  Lower-casing other letters than A-Z changes no
    word's borders and no template word."""
    return F.filter(F.split(F.lower(text), DELIMITERS), lambda w: w != "")


def votes(docs: DataFrame, notices: Sequence[tuple[str, str, str]] = NOTICES) -> DataFrame:
    """Votes per document, template and diagonal; a document without any has
    one row without a template."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"),
                    F.col("doc_id").cast("long").alias("doc_id"), words_of(text).alias("w"))
    n = F.size("w")
    z = F.arrays_zip(F.col("w").alias("w0"), *(
        F.slice("w", F.lit(j + 1), F.greatest(n - j, F.lit(0))).alias(f"w{j}")
        for j in range(1, LONG_GRAM)))
    places = (d.select("row", "doc_id", n.cast("long").alias("n_words"),
                       F.posexplode_outer(z).alias("pos", "z"))
              .select("row", "doc_id", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"),
                      *(F.col(f"z.w{j}").alias(f"w{j}") for j in range(LONG_GRAM)))
              .withColumn("key", F.xxhash64("w0", "w1")))
    t = template_table(spark, notices)
    hit = ((F.col("key") == F.col("tkey")) & (F.col("w0") == F.col("t0"))
           & (F.col("w1") == F.col("t1"))
           & (F.col("t2").isNull() | ((F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3")))))
    found = places.join(t, hit, "left").filter(F.col("template").isNotNull() | (F.col("pos") == 0))
    return (found.groupBy("row", "doc_id", "n_words", "template", *KIND,
                          (F.col("pos") - F.col("tpos")).alias("diagonal"))
            .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"),
                 F.max("pos").alias("last"), F.max("marked").alias("marked")))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans: a phrase or SPDX line on one diagonal with all its votes,
    a notice over neighbouring diagonals with ``least`` of them, its mark too.  Rows without a
    template stay, as their documents' only rows."""
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    near = (~F.col("exact") & (F.col("first") - F.lag("last").over(order) <= GAP)
            & (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= DRIFT))
    parts = voted.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)) \
        .withColumn("part", F.sum("new").over(order))
    merged = parts.groupBy("row", "doc_id", "n_words", "template", *KIND, "part").agg(F.sum("votes").alias("votes"),
                F.min("first").alias("first"),
                F.max("last").alias("last"), F.max("marked").alias("marked"))
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    good = F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise(
        (share >= F.col("least")) & F.col("marked"))
    return merged.withColumn("share", F.when(F.col("template").isNotNull() & good, share))


def scan(docs: DataFrame, notices: Sequence[tuple[str, str, str]] = NOTICES) -> DataFrame:
    """``notices``: (words in lower case, label, mark) each.  Per document: n_words, n_base, first_word, last_word, base_labels,
    labels, score (largest verified share of a template)."""
    s = spans(votes(docs, notices))
    is_base = F.col("base") & F.col("share").isNotNull()

    def listed(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return s.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.when(is_base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        listed(is_base).alias("base_labels"),
        listed(F.col("share").isNotNull()).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score")).drop("row")
