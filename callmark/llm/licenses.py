"""License scans as an exact set-similarity join (operator 9); DataFrame functions only.

Templates are license notices, one-sentence ones and whole ones. Texts are split into words once; what is kept of them are the
templates' words, each at its place, in a working table. Texts are cut into overlapping blocks of words, for templates of up
to STRIDE words into blocks of BLOCK words, for longer ones into blocks larger by a power of two; so every template lies
within some block of its size, and long ones change nothing for short ones. A block matches a template if it contains at least ``threshold`` of
the template's different words. Tokens are put in one global order, rarest in the corpus
first. A block with an overlap of o tokens with a template of t shares, with the first t - o + 1 of the template, at least
one of its own first tokens: only those are joined (prefix filter). Blocks with fewer than o tokens of any template go
beforehand (length filter), and a pair goes if what follows the first shared token, on either side, cannot reach o
(positional filter). What is left is verified. Tokens that no template has can add to no overlap and are left out.

Beside the method stands the base: places where a phrase's words stand consecutively.

Defined results: a null text counts as the empty text, with no words and no labels; a long text is cut into as many blocks as
it needs; repeated rows are reported each; rows without doc_id are reported with null; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import materialise, name, table, whole

# What separates words once A-Z are lower case, and the base's phrases and labels.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences and whole notices, and their labels.
NOTICES = {
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Licensed under the Apache License, Version 2.0": "apache",
    "you may not use this file except in compliance with the License": "apache",
    "This work is licensed under the GNU General Public License version 3": "gpl",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "GNU Lesser General Public License version": "lgpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "subject to the terms of the Mozilla Public License": "mpl",
    "licensed under a Creative Commons Attribution": "cc-by",
    "free and unencumbered software released into the public domain": "unlicense",
    "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
    publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
    substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
    NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
    OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit-full",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
    writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
    express or implied. See the License for the specific language governing permissions and limitations under the License.""": "apache-full",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
    by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
    the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
    PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
    along with this program. If not, see https://www.gnu.org/licenses/.""": "gpl-full",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
    are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
    "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
    PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
    DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd-full",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
    the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
    WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
    LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
    WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE.""": "isc-full",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
    file, You can obtain one at https://mozilla.org/MPL/2.0/.""": "mpl-full",
}
TEMPLATES = {" ".join(re.split(BREAK, t.lower())).strip(): label for t, label in NOTICES.items()}
#: A block's words and how far apart blocks begin, for templates of up to STRIDE words.
BLOCK, STRIDE = 48, 24
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BREAK), lambda w: w != "")


def literal(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def places(own: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after another, from 0."""
    starts = F.sequence(F.lit(0), F.size(own) - len(phrase))
    there = lambda i: [F.get(own, i + k) == w for k, w in enumerate(phrase)]

    def all_there(i: Column) -> Column:
        first, *rest = there(i)
        for x in rest:
            first = first & x
        return first

    has = F.array_contains(own, phrase[0]) & (F.size(own) >= len(phrase))
    return F.when(has, F.filter(starts, all_there)).otherwise(F.expr("array()").cast("array<int>"))


def tagged(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """docs (doc_id, text) with text_key, n_words, n_base, first_word, last_word, base (labels), and held: the text's words, those of no
    template as empty strings. The one place where texts are split."""
    vocabulary = sorted({w for t in templates for w in t.split()})
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    found = {p: f"p{i}" for i, p in enumerate(PHRASES)}
    own = own.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), *(places(F.col("words"), p.split()).alias(c) for p, c in found.items()), F.transform("words", lambda w: F.when(w.isin(vocabulary), w).otherwise("")).alias("held"))
    everywhere = F.concat(*found.values())
    return own.select(
        "doc_id", "text_key", "n_words", F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"), F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.size(c) > 0, PHRASES[p]) for p, c in found.items()))).alias("base"), "held",
    )


def token_order(own: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' tokens, those in the fewest documents first; as many rows as the templates have tokens reach the driver."""
    vocabulary = sorted({w for t in templates for w in t.split()})
    seen = own.select(F.explode(F.array_distinct("held")).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scale(template: str) -> int:
    """The least power of two by which STRIDE has to grow to have as many words as the template."""
    return 1 << (-(-len(template.split()) // STRIDE) - 1).bit_length()


def matches(own: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, block (its number at the template's scale), template, label, containment: every block that contains enough of a template. own: tagged()."""
    order = token_order(own, templates)
    scales = sorted({scale(t) for t in templates})
    return reduce(DataFrame.unionByName, (_matches(own, {t: label for t, label in templates.items() if scale(t) == n}, threshold, order, n * BLOCK, n * STRIDE) for n in scales))


def _matches(own: DataFrame, templates: dict[str, str], threshold: float, order: list[str], size: int, stride: int) -> DataFrame:
    """matches of templates of one scale in blocks of so many words every stride."""
    own_words = {w for t in templates for w in t.split()}
    order = [w for w in order if w in own_words]
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t, label in templates.items():
        tokens = sorted({*t.split()}, key=rank.__getitem__)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        rows.append((t, label, tokens, need, tokens[: len(tokens) - need + 1]))
    least = min(r[3] for r in rows)
    prefixes = sorted({w for r in rows for w in r[4]}, key=rank.__getitem__)
    spark = own.sparkSession
    side = spark.createDataFrame(rows, "template string, label string, tokens array<string>, need int, prefix array<string>").select("*", F.posexplode("prefix").alias("q", "token"))

    own = own.select("doc_id", "text_key", "held").filter(F.arrays_overlap(literal(prefixes), "held"))
    last = F.greatest(F.lit(0), F.ceil((F.size("held") - size) / stride)).cast("int")
    blocks = own.select("doc_id", "text_key", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("held", i * stride + 1, F.lit(size)))).alias("block", "held"))
    held = blocks.select("doc_id", "text_key", "block", F.array_intersect(literal(order), "held").alias("held")).filter(F.size("held") >= least)
    tried = held.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("p", "token"))
    pairs = tried.join(F.broadcast(side), "token").filter(
        (F.size("held") >= F.col("need"))
        & (1 + F.least(F.size("held") - F.col("p") - 1, F.size("tokens") - F.col("q") - 1) >= F.col("need"))
        & (F.get(F.array_intersect("held", "tokens"), F.lit(0)) == F.col("token"))  # the first shared token alone: each pair once
    )
    overlap = F.size(F.array_intersect("held", "tokens"))
    return pairs.filter(overlap >= F.col("need")).select("doc_id", "text_key", "block", "template", "label", (overlap / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    docs = docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), whole(name(text_col)).alias("text"))
    own = materialise(tagged(docs, templates))
    found = matches(own, templates, threshold).groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = own.drop("held").join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.expr("array()").cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    rows = ", ".join(f"('{t}', '{label}', {scale(t)})" for t, label in TEMPLATES.items())
    return f"""
WITH own AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), phrases AS (
    SELECT * FROM (VALUES {", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())}) t(phrase, label)
), based AS (
    SELECT r, label, i - 1 AS start FROM (
        SELECT r, w, label, phrase, unnest(range(1, len(w) + 1)) AS i FROM own, phrases WHERE list_contains(w, 'license'))
    WHERE array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), base AS (
    SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_distinct(list(label)) AS labels FROM based GROUP BY r
), templates AS (
    SELECT label, s, list_distinct(string_split(t, ' ')) AS tokens FROM (VALUES {rows}) t(t, label, s)
), blocks AS (
    SELECT r, s, w[b * s * {STRIDE} + 1 : b * s * {STRIDE} + s * {BLOCK}] AS held FROM (
        SELECT r, s, w, unnest(range(0, greatest(0, ceil((len(w) - s * {BLOCK}) / (s * {STRIDE})))::BIGINT + 1)) AS b FROM own, (SELECT DISTINCT s FROM templates))
), matched AS (
    SELECT r, list_distinct(list(label)) AS labels, max(c) AS best FROM (
        SELECT r, label, len(list_intersect(tokens, held))::DOUBLE / len(tokens)::DOUBLE AS c FROM blocks JOIN templates USING (s))
    WHERE c >= {THRESHOLD} - 1e-9 GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(matched.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM own LEFT JOIN base USING (r) LEFT JOIN matched USING (r)
"""
