"""License scans by diagonal voting, in DataFrame functions only.

Every rolling pair of words (k = 2, the length of the shortest phrase) of a
text is hashed and joined with the word pairs of all templates. A match at
text place p and template place t votes for the diagonal p - t. Votes are
summed by diagonal; a phrase stands where its diagonal has all its votes.
Diagonals of a template that lie within ``DRIFT`` of each other are merged
into spans, so that a notice with words put in or left out is still one
span, and a span's label holds if it covers ``COVER`` of the template's pairs.
Words are compared as well as hashes. A template's covered places are bits of
as many integers (segments of ``SEGMENT`` places) as it needs, so templates
may have any length. All pairs vote, those of frequent words too.

The templates are fixed and few (some 500 pairs), so they are broadcast. The
join keeps one row for each text besides the matches, and everything after it
is grouped by a number that each row gets when it is read; no text is read
twice.

Defined results: a null or empty text, or one without words, has n_words 0,
no places, empty labels and score 0. score is the best cover of any span, 0
without one. Repeated rows and null ids are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import documents

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DRIFT = 2
COVER = 0.7
SEGMENT = 60

#: The phrases and labels that are asked for.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Opening or naming sentences of well-known licenses, and whole texts or notices of some.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("no part of this publication may be reproduced", "reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
)


def template_pairs():
    """(tid, label, base, t, size, first word, second word): one for each pair of neighbouring words of each template; size is their number."""
    for tid, (words, label, base) in enumerate([(p, x, True) for p, x in PHRASES] + [(p, x, False) for p, x in NOTICES]):
        w = words.split()
        yield from ((tid, label, base, t, len(w) - 1, w[t], w[t + 1]) for t in range(len(w) - 1))


def pairs(spark: SparkSession) -> DataFrame:
    """tid, label, base, t, size, wa, wb, h: one row for each pair of ``template_pairs``."""
    rows = [f"({tid}, '{label}', {str(base).lower()}, {t}, {size}, '{a}', '{b}')" for tid, label, base, t, size, a, b in template_pairs()]
    return spark.sql("SELECT *, xxhash64(wa, wb) AS h FROM VALUES " + ", ".join(rows) + " AS x(tid, label, base, t, size, wa, wb)")


def votes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, tid, label, base, size, diagonal, segment, covered (bits of template places): by diagonal and segment; tid is null on one row of each text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = documents(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)).alias("w"))
    rolling = words.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p", "pair"))
    rolling = rolling.select("rid", "doc_id", "n_words", F.coalesce("p", F.lit(0)).alias("p"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).withColumn("hash", F.xxhash64("a", "b"))
    met = rolling.join(F.broadcast(pairs(docs.sparkSession)), (F.col("hash") == F.col("h")) & (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")), "left").where("tid IS NOT NULL OR p = 0")
    # a text whose first pair matches has no row without a match: its matches carry doc_id and n_words as well
    voted = met.select("rid", "doc_id", "n_words", "tid", "label", "base", "size", (F.col("p") - F.col("t")).cast("long").alias("diagonal"), F.expr(f"t div {SEGMENT}").alias("segment"), F.expr(f"shiftleft(1L, t % {SEGMENT})").alias("place"))
    return voted.repartition("rid").groupBy("rid", "doc_id", "n_words", "tid", "label", "base", "size", "diagonal", "segment").agg(F.bit_or("place").alias("covered"))


def spans(voted: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged: rid, doc_id, n_words, tid, label, base, cover, and the places of whole phrases: n, first, last."""
    near = Window.partitionBy("rid", "tid").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > DRIFT, F.lit(True)) | F.col("base")
    numbered = voted.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(near))
    whole = F.col("base") & (F.bit_count("covered") == F.col("size"))
    own = ["rid", "doc_id", "n_words", "tid", "label", "base", "size", "span"]
    by_segment = numbered.groupBy(*own, "segment").agg(F.bit_count(F.bit_or("covered")).alias("k"), F.count_if(whole).alias("n"), F.min(F.when(whole, F.col("diagonal"))).alias("first"), F.max(F.when(whole, F.col("diagonal"))).alias("last"))
    return by_segment.groupBy(*own).agg((F.sum("k") / F.col("size")).alias("cover"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of docs."""
    found = spans(votes(docs)).withColumn("holds", F.when(F.col("base"), F.col("n") > 0).otherwise(F.col("cover") >= COVER))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.when(c, F.col("label")))))
    out = found.groupBy("rid", "doc_id", "n_words").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), joined(F.col("base") & F.col("holds")).alias("base_labels"), joined(F.col("holds")).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score")
    )
    return out.drop("rid")
