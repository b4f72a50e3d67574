r"""License scans by diagonal voting, in DataFrame operations throughout.

The rolling hashes of all word k-grams of every text (``SHORT`` words for phrases, ``LONG`` for whole license texts) meet
the positions of the same k-grams in the templates, a fixed table of some thousand rows, which is broadcast. Hashes that no
template has are left out inside the array of a text, by a hash set of the same table, so only what may match becomes a row.
A match is verified by its words, and votes for a template and a diagonal, the word of the text at which the template would
start. Votes are gathered by diagonal. Neighbouring diagonals merge: words that were put in or left out move the rest of a
license text to the next diagonal. A span belongs to a diagonal and holds those up to a fixed drift from it (2 words for
phrases, 8 for texts), so spans do not run on in chains: all of its words stand in the order of the template but for the
drift, within its length and the drift. A span is verified if enough different k-grams of the template are in it: ``COVERAGE``
of a phrase's, ``TEXT_COVERAGE`` of a text's. A base phrase counts where all its pairs are on one diagonal.

Defined results: a null, empty or wordless text has n_words 0, no places and empty
labels. Repeated rows give repeated results; a null doc_id stays null; an empty
table gives no rows. Texts are scanned whole. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import documents

#: Phrases whose places are counted, and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Wordings by which common licenses are known.
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: License texts and notices as they stand in files.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished
        to do so, all subject to the following"""),
)
#: Words of a k-gram of phrases and of texts; shares of a template's k-grams that a span needs.
SHORT, LONG, COVERAGE, TEXT_COVERAGE = 2, 4, 0.7, 0.5
#: Drift of a span's diagonals in words, of texts; that of phrases is a fourth.
DRIFT, FINER = 8, 4
#: What stands between words, after A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one sign outside ASCII whose lower case is an ASCII letter by itself; it gets a stand-in of the same class.
KELVIN, STAND_IN = "K", "ĸ"


def _positions() -> list[tuple[int, str, bool, int, int, int, int, float, str]]:
    """template, label, base, its words, k, number of k-grams, position, coverage, and the k-gram, for each k-gram."""
    out = []
    phrases = [(label, text, True) for label, text in BASE] + [(label, text, False) for label, text in TEMPLATES]
    for t, (label, text, base) in enumerate([*phrases, *((label, text, False) for label, text in TEXTS)]):
        words = re.findall("[0-9a-z]+", text.lower())
        k, share = (SHORT, COVERAGE) if t < len(phrases) else (LONG, TEXT_COVERAGE)
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        out += [(t, label, base, len(words), k, len(grams), i, share, g) for i, g in enumerate(grams)]
    return out


POSITIONS = _positions()


def template_grams(spark: SparkSession) -> DataFrame:
    schema = "template int, label string, base boolean, words int, k int, grams int, offset int, share double, gram string"
    return spark.createDataFrame(POSITIONS, schema)


def _matches(words: Column, k: int) -> Column:
    """The k-grams of ``words`` whose hash one of the templates has, with their places."""
    spell = lambda i: F.array_join(F.slice(words, i + 1, k), " ")
    rolled = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    known = sorted({tuple(g.split(" ")) for *_, own, _, _, _, g in POSITIONS if own == k})
    hashes = [F.xxhash64(*map(F.lit, g)) for g in known]
    places = F.when(F.size(words) >= k, F.filter(F.sequence(F.lit(0), F.size(words) - k), lambda i: rolled(i).isin(*hashes)))
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), spell(i).alias("gram")))


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of ``docs``."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(KELVIN), F.lit(STAND_IN))
    words = F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    found = F.concat(_matches(F.col("words"), SHORT), _matches(F.col("words"), LONG))
    each = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(found).alias("m"))
    t = F.broadcast(template_grams(spark)).alias("t")  # as many rows as the templates have words
    votes = each.join(t, (F.col("m.k") == F.col("t.k")) & (F.col("m.gram") == F.col("t.gram")), "left")
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "grams", "share"]
    diagonals = votes.groupBy(*keys, "t.k", (F.col("m.pos") - F.col("offset")).cast("long").alias("diagonal")).agg(
        F.collect_list("offset").alias("offsets")
    )

    place = F.when(F.col("base") & (F.size("offsets") == F.col("grams")), F.col("diagonal"))
    fine = F.col("diagonal") * F.when(F.col("k") == SHORT, FINER).otherwise(1)
    near = Window.partitionBy("row", "template").orderBy(fine).rangeBetween(-DRIFT, DRIFT)
    merged = diagonals.withColumn("hits", F.size(F.array_distinct(F.flatten(F.collect_list("offsets").over(near))))).withColumn("place", place)
    spans = merged.groupBy(*keys).agg(
        F.max("hits").alias("hits"), F.count("place").alias("places"), F.min("place").alias("first_word"), F.max("place").alias("last_word")
    )
    part = F.when(F.col("grams").isNotNull(), F.col("hits") / F.col("grams"))
    found = F.when(F.col("base"), F.col("places") > 0).otherwise(part >= F.col("share"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum("places").cast("long").alias("n_base"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        joined(F.when(F.col("base") & found, F.col("label"))).alias("base_labels"),
        joined(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("base"), found.cast("double")).otherwise(part)), F.lit(0.0)).alias("score"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, documents(spark, sf_dir)).drop("row")


_VALUES = ", ".join(f"({t}, '{label}', {base}, {k}, {grams}, {place}, {share}, '{gram}')" for t, label, base, _, k, grams, place, share, gram in POSITIONS)

OP3_SQL = rf"""
WITH t(template, label, base, k, grams, place, needed, gram) AS (VALUES {_VALUES}),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
p AS (SELECT row, pos, word || ' ' || lead(word) OVER o AS two,
             word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS four
      FROM w WINDOW o AS (PARTITION BY row ORDER BY pos)),
v AS (
  SELECT row, pos - place AS diagonal, place, t.* EXCLUDE (place, gram) FROM p JOIN t ON k = {SHORT} AND two = gram
  UNION ALL SELECT row, pos - place, place, t.* EXCLUDE (place, gram) FROM p JOIN t ON k = {LONG} AND four = gram),
g AS (SELECT row, template, label, base, k, grams, needed, diagonal, list(place) AS places FROM v GROUP BY ALL),
m AS (
  SELECT *, len(list_distinct(flatten(list(places) OVER (PARTITION BY row, template ORDER BY diagonal * CASE k WHEN {SHORT} THEN {FINER} ELSE 1 END
                                                         RANGE BETWEEN {DRIFT} PRECEDING AND {DRIFT} FOLLOWING)))) AS hits FROM g),
x AS (
  SELECT row, template, label, base, grams, needed, max(hits) AS hits,
         count(*) FILTER (base AND len(places) = grams) AS places,
         min(diagonal) FILTER (base AND len(places) = grams) AS first_word,
         max(diagonal) FILTER (base AND len(places) = grams) AS last_word
  FROM m GROUP BY ALL),
f AS (
  SELECT *, hits / grams::DOUBLE AS share,
         CASE WHEN base THEN places > 0 ELSE hits / grams::DOUBLE >= needed::DOUBLE END AS found
  FROM x),
r AS (
  SELECT row, CAST(sum(places) AS BIGINT) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND found) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels,
         max(CASE WHEN base THEN CAST(found AS DOUBLE) ELSE CAST(share AS DOUBLE) END) AS score
  FROM f GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (row)
"""
