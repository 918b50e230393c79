"""License scans (native): an exact containment join of text blocks with license templates.

A block is a run of words, whatever lines and marks lie between them, so wrapped and commented notices are found like
others. It is as long as the template's own text divided by the containment, which leaves room for words put in.

Words of the templates are ranked by how many documents hold them, rarest first. A block that holds at least
`need` of a template's n distinct words holds one of its n - need + 1 rarest (prefix filter; a word further back in
the order would leave too few behind it, the positional filter). So a place of such a word is where blocks are looked
for: all that contain the place, from the words around it. These must hold `need` of the template's words at all
(length filter); then every block that begins with a template word is verified by intersecting the full sets. Only
documents with such a word are exploded, into rows of a place and the words around it; templates are a stated list of
at most MAX_TEMPLATES, and their prefix words are broadcast.

Besides, phrases that name a license are counted wherever their words stand consecutively.

Defined cases: null text is empty; documents without any match have no labels, null places and score 0; a text of
any length is split once for each phrase it holds; ties and repeated templates or blocks add nothing; rows equal in
id and text are one document with equal results; an empty table gives an empty result; other columns aren't read."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from trellis.llm.common import ascii_lower, col, pinned

#: A character that is part of a word: digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Public notices that name their license, and the texts of short licenses.
TEMPLATES = (
    ("agpl", "GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
        " and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
        " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
        " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
        " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights"
        " to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
)
CONTAINMENT = 0.9
MAX_TEMPLATES = 1000


def template_words(text: str) -> list[str]:
    """Its distinct words, sorted."""
    return sorted(set(_all_words(text)))


def _all_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def block_words(text: str, containment: float = CONTAINMENT) -> int:
    """Words in a block that is compared with a template."""
    return math.ceil(len(_all_words(text)) / containment - 1e-9)


def needed_words(text: str, containment: float = CONTAINMENT) -> int:
    """Distinct words of a template that a block has to hold."""
    return max(1, math.ceil(containment * len(template_words(text)) - 1e-9))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD + "+")).cast("long")


def _phrase(phrase: str) -> str:
    """Its words with any breaks between, not inside other words; upper and lower case A-Z alike."""
    return f"(?i)(?<!{WORD})" + f"{BREAK}+".join(phrase.split()) + f"(?!{WORD})"


def places(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels (array) to rows with a text; no shuffle."""
    rows = docs.withColumn("n_words", count_words(F.col("text")))
    for k, (phrase, _) in enumerate(phrases):
        pattern = _phrase(phrase)
        rows = rows.withColumn(f"_p{k}", F.when(F.col("text").rlike(pattern), F.split("text", pattern)))
    for k, (phrase, _) in enumerate(phrases):
        parts, size = F.col(f"_p{k}"), len(phrase.split())
        rows = rows.withColumn(f"_n{k}", F.coalesce(F.size(parts) - 1, F.lit(0)).cast("long"))
        rows = rows.withColumn(f"_a{k}", count_words(F.get(parts, F.lit(0))))
        rows = rows.withColumn(f"_b{k}", F.col("n_words") - count_words(F.element_at(parts, -1)) - size)
    every = range(len(phrases))
    pick = lambda f, x: f(*[F.col(f"_{x}{k}") for k in every]) if len(phrases) > 1 else F.col(f"_{x}0")
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.col(f"_n{k}") > 0, F.lit(phrases[k][1])) for k in every]), lambda x: x.isNotNull())))
    rows = rows.withColumn("n_base", sum((F.col(f"_n{k}") for k in every), F.lit(0)).cast("long"))
    rows = rows.withColumn("first_word", pick(F.least, "a")).withColumn("last_word", pick(F.greatest, "b")).withColumn("base_labels", labels)
    return rows.drop(*[f"_{x}{k}" for k in every for x in "pnab"])


def word_order(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Each template word's rank by the number of documents that hold it (then by itself). At most the templates'
    words come to the driver."""
    words = F.split(F.lower("text"), BREAK + "+")
    held = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in held.collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def similar_blocks(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(key, label, containment): for each label the best block of a document that holds the share of its distinct words."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; the broadcast is sized for {MAX_TEMPLATES}")
    spark = docs.sparkSession
    order = word_order(docs, sorted({w for _, text in templates for w in template_words(text)}))
    rows = []
    for label, text in templates:
        ranked = sorted(template_words(text), key=order.get)
        need = needed_words(text, containment)
        rows += [(w, label, need, block_words(text, containment), ranked) for w in ranked[: len(ranked) - need + 1]]
    index = spark.createDataFrame(rows, "word string, label string, need int, reach int, wanted array<string>")
    prefix = F.array(*map(F.lit, sorted({r[0] for r in rows}, key=order.get)))

    words = docs.select("key", pinned(F.split(ascii_lower(F.col("text")), BREAK + "+")).alias("words")).where(F.arrays_overlap("words", prefix))
    spots = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(prefix, w), i)), lambda i: i.isNotNull())
    found = words.select("key", "words", F.explode(spots).alias("at")).withColumn("word", F.get("words", F.col("at"))).join(F.broadcast(index), "word")
    # The words that a block around the place can have, and where the place is among them.
    first = F.greatest(F.col("at") - F.col("reach") + 1, F.lit(0))
    found = found.select("key", "label", "need", "reach", "wanted", (F.col("at") - first).alias("at"), F.slice("words", first + 1, F.col("at") - first + F.col("reach")).alias("around"))
    found = found.where(F.size(F.array_intersect("around", "wanted")) >= F.col("need"))
    starts = F.filter(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("reach") + 1), F.col("at")), lambda i: F.array_contains(F.col("wanted"), F.get(F.col("around"), i)))
    common = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(F.col("around"), i + 1, F.col("reach")), F.col("wanted"))))
    found = found.withColumn("common", pinned(F.array_max(common))).where("common >= need")
    return found.groupBy("key", "label").agg(F.max(F.col("common") / F.size("wanted")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row; labels are arrays."""
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    found = similar_blocks(rows, templates, containment).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = places(rows, phrases).select("key", "n_words", "n_base", "first_word", "last_word", "base_labels")
    out = base.join(found.withColumnRenamed("key", "fkey"), F.col("key").eqNullSafe(F.col("fkey")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("key.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
