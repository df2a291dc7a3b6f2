"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Lines, paragraphs, runs of one to four neighbouring sentences and whole texts are compared, so that a notice is found
where it stands: wrapped, in comment signs, behind other sentences of its line, or as several paragraphs of a longer
text.  Two bounds prune before any bigram is made, and neither can drop a match: a template of b bigrams reaches Dice t only with sizes from
b * t / (2 - t) to b * (2 - t) / t, and with at least b * t / (2 - t) of its own bigrams; the anchor words of a
template are chosen so that fewer of its bigrams hold none of them, so a text without any anchor word is left out.
DataFrame operations only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import table, text_or_empty

THRESHOLD = 0.8
#: Sentences end at a full stop, ! or ? before white space, and at blank lines; the longest template has four.
SENTENCE_END = "[.!?]+[ \t\n]+|\n[ \t]*\n"
MOST_SENTENCES = 4

# Short public licence texts and customary notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split(" ") if w]


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


# Short words that ordinary text is full of; they make poor anchors.
ORDINARY = frozenset("a an and any are as at be by can for from if in is it its no not of on or that the this to was with you".split())


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which each match has one: a template's longest, until its bigrams without any are too few to match.

    Words that are anchors already come first, ordinary ones last.
    """
    out: set[str] = set()
    for text in templates.values():
        words = normal_words(text)
        pairs = bigrams(words)
        needed = math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
        for word in sorted(set(words), key=lambda w: (w not in out, w in ORDINARY, -len(w), w)):
            if sum(out.isdisjoint(p.split(" ")) for p in pairs) < needed:
                break
            out.add(word)
    return sorted(out)


def any_word(words: list[str]) -> str:
    """A pattern that finds one of the words, by their first letters; ASCII case only."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in sorted(by.items()))})(?![a-z0-9])"


def sentence_runs(told: Column, k: int) -> Column:
    """The runs of k sentences of which one has an anchor word."""
    runs = F.transform(told, lambda _, i: F.struct(F.lit(f"{k} sentences").alias("extent"), i.alias("nth"), F.slice(told, i + 1, k).alias("own")))
    kept = F.filter(runs, lambda r: (F.size(r["own"]) == k) & F.exists(r["own"], lambda s: s["met"]))
    return F.transform(kept, lambda r: F.struct(r["extent"].alias("extent"), r["nth"].alias("nth"), F.array_join(F.transform(r["own"], lambda s: s["place"]), " ").alias("place")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, licence, dice, n_places): the best coefficient of each text and template that reach the threshold.

    Places are the lines, paragraphs, whole text, and runs of up to MOST_SENTENCES neighbouring sentences that hold a
    word, in which the template is met, equal places of one extent counted once for each.  Dice is over distinct bigrams of words [a-z0-9]+, A-Z lower-cased, rounded to 6 places.  Null and
    empty texts, and texts of one word, match nothing; rows that repeat an id are one text's places together; a null
    id is kept.  Other columns are not read.
    """
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    pairs = [(name, b, len(own)) for name, t in sorted(templates.items()) for own in [bigrams(normal_words(t))] for b in sorted(own)]
    sizes = sorted({n for _, _, n in pairs})
    least, most = math.ceil(sizes[0] * threshold / (2 - threshold) - 1e-9), math.floor(sizes[-1] * (2 - threshold) / threshold + 1e-9)
    words = anchors(templates, threshold)

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    split = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    # The anchors first, on whole texts; a text without them has no place with them.
    rows = rows.where(F.col("text").rlike(any_word(words)))
    # Then on its lines, paragraphs and sentences, before any of them is taken to words.
    met = lambda t: t.rlike(any_word(words))
    place = lambda extent: lambda t, i: F.struct(F.lit(extent).alias("extent"), i.alias("nth"), t.alias("place"))
    told = F.filter(F.split("text", SENTENCE_END), lambda t: t.rlike("[A-Za-z0-9]"))
    rows = rows.select("id", "text", F.transform(told, lambda t: F.struct(t.alias("place"), met(t).alias("met"))).alias("told"))
    places = F.concat(
        F.transform(F.filter(F.split("text", "\n"), met), place("line")),
        F.transform(F.filter(F.split("text", "\n[ \t]*\n"), met), place("paragraph")),
        F.array(place("text")(F.col("text"), F.lit(0))),
        *(sentence_runs(F.col("told"), k) for k in range(1, MOST_SENTENCES + 1)),
    )
    units = rows.select("id", F.xxhash64("text").alias("of"), F.explode(places).alias("p")).select("id", "of", "p.extent", "p.nth", split(F.col("p.place")).alias("words"))
    units = units.where(F.size("words") > least)
    count = F.greatest(F.size("words") - 1, F.lit(0))
    grams = F.array_distinct(F.zip_with(F.slice("words", 1, count), F.slice("words", 2, count), lambda a, b: F.concat_ws(" ", a, b)))
    units = units.select("id", "of", "extent", "nth", grams.alias("grams")).withColumn("size", F.size("grams")).where(F.col("size").between(least, most))

    names = F.broadcast(spark.createDataFrame(pairs, "licence string, gram string, template_size int"))
    met = units.select("id", "of", "extent", "nth", "size", F.explode("grams").alias("gram")).join(names, "gram")
    met = met.where((F.col("size") >= F.col("template_size") * threshold / (2 - threshold) - 1e-9) & (F.col("size") <= F.col("template_size") * (2 - threshold) / threshold + 1e-9))
    scored = met.groupBy("id", "of", "extent", "nth", "licence", "size", "template_size").agg(F.count("*").alias("common"))
    dice = F.round(2.0 * F.col("common") / (F.col("size") + F.col("template_size")), 6)
    found = scored.withColumn("dice", dice).where(2.0 * F.col("common") >= threshold * (F.col("size") + F.col("template_size")) - 1e-9)
    return found.groupBy(F.col("id").alias(id_col), "licence").agg(F.max("dice").alias("dice"), F.count("*").alias("n_places"))


def op7_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH t(licence, body) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEMPLATES.items())}),
tw AS (SELECT licence, list_filter(string_split(regexp_replace(translate(body, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM t),
tg AS (SELECT licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
tb AS (SELECT licence, len(g) AS template_size, unnest(g) AS gram FROM tg),
p AS (
    SELECT doc_id, 'line' AS extent, unnest(string_split(text, chr(10))) AS place, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents
    UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')), generate_subscripts(regexp_split_to_array(text, '\\n[ \\t]*\\n'), 1) FROM documents
    UNION ALL SELECT doc_id, 'text', text, 0 FROM documents),
pl AS (SELECT doc_id, extent, nth, list_filter(string_split(regexp_replace(translate(place, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM p WHERE place IS NOT NULL),
ss AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[ \\t\\n]+|\\n[ \\t]*\\n'), lambda s: list_filter(string_split(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')), lambda w: len(w) > 0) AS told FROM documents),
sk AS (SELECT doc_id, told, k, unnest(range(1, len(told) - k + 2)) AS i FROM ss, (SELECT unnest(range(1, {MOST_SENTENCES + 1})) AS k)),
pw AS (SELECT * FROM pl UNION ALL SELECT doc_id, k || ' sentences', i, flatten(told[i : i + k - 1]) FROM sk),
pg AS (SELECT doc_id, extent, nth, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM pw WHERE len(w) > 1),
pb AS (SELECT doc_id, extent, nth, len(g) AS size, unnest(g) AS gram FROM pg),
s AS (SELECT doc_id, extent, nth, licence, size, template_size, count(*) AS common FROM pb JOIN tb USING (gram) GROUP BY ALL)
SELECT doc_id, licence, max(round(2.0::DOUBLE * common / (size + template_size), 6)) AS dice, count(*) AS n_places
FROM s WHERE 2.0::DOUBLE * common >= {THRESHOLD} * (size + template_size) - 1e-9 GROUP BY doc_id, licence"""

QUERIES = {"op7_licences": op7_licences}
ORACLE_SQL = {"op7_licences": ORACLE}
