"""License scans by diagonal voting (operator 7). DataFrame functions only.

The hashes of all rolling K-word grams of the texts are joined to the places
that templates have them at. Each meeting votes for a diagonal, the document's
position less the template's. A template's meetings in a text are parted where
their places pause for more than ``GAP`` words, then where their diagonals leap
by more than ``DRIFT``, and both once more, since one parting can open the other. What
stays together is a span: that bridges words that were put in or left out, and
a stray gram on a far diagonal parts nothing. A span is verified word by
word: a word of the template counts if the text has the same word where one of
the span's diagonals puts it. Enough of the template and of the span must count.
Of spans that overlap the one with more such words stays.

Besides, places where the words of three fixed phrases stand consecutively are
counted.

One pass cuts the words of all documents and writes down a header of each row,
with its words counted, and its meetings, which carry the words around them. The
templates are a fixed table of some thousand grams, so that side is broadcast.
What is shuffled later is dealt by document row. A row's own meetings come
together in one task, which its length bounds.

Null and empty texts have no words, places or labels. Repeated rows give
repeated results. In an empty table nothing is found. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .words import WORD, words

#: Words of a gram.
K = 3
#: How far neighbouring diagonals of one span may lie apart, and how many words between them may be foreign.
DRIFT, GAP = 4, 12
#: Least share of a template's words, and of a span's, that must be the same.
COVERAGE, DENSITY = 0.6, 0.5
#: Words that a meeting carries on either side of its gram: those of neighbours close any gap within a span.
AROUND = GAP // 2

#: Phrases and labels (fixed values).
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Well-known licences and notices, as their owners publish them (fixed values); a label may have several.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "mit",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]


def _template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(w: Column) -> Column:
    """The hash of every K consecutive words of a column, in order."""
    n = F.size(w) - K + 1
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(K)])),
    ).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(label, template, tw): the words of each template. Templates of fewer than K words are refused."""
    if short := [text for _, text in templates if len(_template_words(text)) < K]:
        raise ValueError(f"templates need {K} words or more: {short}")
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(i).alias("template"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.label", "t.template", words(F.col("t.text")).alias("tw"))


_HEADER = -1


def meetings(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, places, template, pos, at, first, near): a header of each document row, and where it has which gram of which template.

    near are the words of the text around the gram, from word first on.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    header = F.array(F.struct(F.lit(_HEADER).alias("pos"), F.lit(0).cast("long").alias("h")))
    placed = F.transform(grams(F.col("w")), lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    # the array is a column of its own, so that cutting it up and the join are one piece of generated code and words aren't
    # copied; it is never empty, and "outer" keeps the planner from working it out once more to see that
    each = own.select("row", "doc_id", "w", F.concat(header, placed).alias("all")).select("row", "doc_id", "w", F.explode_outer("all").alias("g"))
    known = templates.select("template", F.posexplode(grams(F.col("tw"))).alias("at", "h"))
    known = known.unionAll(docs.sparkSession.range(1).select(F.lit(_HEADER).alias("template"), F.lit(_HEADER).alias("at"), F.lit(0).cast("long").alias("h")))
    met = each.select("row", "doc_id", "w", "g.pos", "g.h").join(F.broadcast(known), "h").where((F.col("pos") == _HEADER) == (F.col("template") == _HEADER))
    first, is_header = F.greatest(F.col("pos") - AROUND, F.lit(0)), F.col("pos") == _HEADER
    return met.select(
        "row",
        F.when(is_header, F.col("doc_id")).alias("doc_id"),
        F.when(is_header, F.size("w").cast("long")).alias("n_words"),
        F.when(is_header, phrase_places(F.col("w"))).alias("places"),
        "template",
        "pos",
        "at",
        first.alias("first"),
        F.when(~is_header, F.slice("w", first + 1, F.col("pos") - first + K + AROUND)).alias("near"),
    )


def _parted(df: DataFrame, keys: list[str], value: str, pause: int) -> tuple[DataFrame, list[str]]:
    """df with one more key: a number that grows where the value, in order, leaps by more than a pause."""
    name, own = f"part{len(keys)}", Window.partitionBy(*keys)
    leaps = F.coalesce(F.col(value) - F.lag(value).over(own.orderBy(value)) > pause, F.lit(False))
    marked = df.withColumn("_leap", leaps.cast("int"))
    return marked.withColumn(name, F.sum("_leap").over(own.orderBy(value))).drop("_leap"), [*keys, name]


def spans(met: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, label, first_word, last_word, coverage, same): verified spans, ends included, of meetings."""
    keys = ["row", "template"]
    parts = met.withColumn("diagonal", F.col("pos") - F.col("at"))
    for value, pause in (("pos", GAP), ("diagonal", DRIFT)) * 2:  # all by row and template, so they share one shuffle
        parts, keys = _parted(parts, keys, value, pause)
    merged = parts.groupBy(*keys).agg(
        F.min("pos").alias("first_word"),
        (F.max("pos") + K - 1).alias("last_word"),
        F.collect_set("diagonal").alias("diagonals"),
        F.collect_list(F.transform("near", lambda w, i: F.struct((i + F.col("first")).alias("at"), w.alias("word")))).alias("near"),
    )
    there = F.map_from_entries(F.array_distinct(F.flatten("near")))
    told = merged.withColumn("there", there).join(F.broadcast(templates), "template")
    inside = lambda i: (i >= F.col("first_word")) & (i <= F.col("last_word"))
    same = F.filter(F.transform("tw", lambda t, j: F.exists("diagonals", lambda d: inside(j + d) & (F.try_element_at("there", j + d) == t))), lambda x: x)
    shares = told.withColumn("same", F.size(same)).withColumn("coverage", F.col("same") / F.size("tw")).withColumn(
        "density",
        F.col("same") / (F.col("last_word") - F.col("first_word") + 1),
    )
    return shares.where((F.col("coverage") >= COVERAGE) & (F.col("density") >= DENSITY)).select("row", "label", "first_word", "last_word", "coverage", "same")


def best_spans(found: DataFrame) -> DataFrame:
    """(row, found_spans): each document row's spans, less those that overlap one with more words that are the same or, of as many, a greater coverage."""
    all_spans = F.array_sort(F.collect_list(F.struct("first_word", "last_word", "label", "coverage", "same")))

    def beaten(s: Column) -> Column:
        more = lambda t: (t["same"] > s["same"]) | ((t["same"] == s["same"]) & (t["coverage"] > s["coverage"]))
        return F.exists("all", lambda t: more(t) & (t["first_word"] <= s["last_word"]) & (s["first_word"] <= t["last_word"]))

    return found.groupBy("row").agg(all_spans.alias("all")).select("row", F.filter("all", lambda s: ~beaten(s)).alias("found_spans"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, places, found_spans) of every document row."""
    known = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    met = written(meetings(docs, known))
    found = best_spans(spans(met.where(F.col("template") != _HEADER), known))
    own = met.where(F.col("template") == _HEADER).select("row", "doc_id", "n_words", "places")
    none = F.array().cast(found.schema["found_spans"].dataType)
    return own.join(found, "row", "left").select("doc_id", "n_words", "places", F.coalesce("found_spans", none).alias("found_spans"))


def phrase_places(w: Column) -> Column:
    """array<struct<at, label>>: where the fixed phrases stand."""

    def label_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            here = F.get(w, i) == phrase[0]
            for k, x in enumerate(phrase[1:], 1):
                here = here & (F.get(w, i + k) == x)
            out = F.when(here, F.lit(label)).otherwise(out)
        return F.struct(i.alias("at"), out.alias("label"))

    may = F.lit(False)
    for phrase in PHRASES:
        may = may | F.array_contains(w, phrase[-1])
    found = F.filter(F.transform(w, lambda _, i: label_at(i)), lambda x: x["label"].isNotNull())
    return F.when(may, found).otherwise(F.array().cast("array<struct<at: int, label: string>>"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    best, named = F.array_max(F.transform("found_spans", lambda s: s["coverage"])), F.transform("found_spans", lambda s: s["label"])
    labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    at = F.transform("places", lambda p: p["at"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, named)), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.array_join(
            F.transform("found_spans", lambda s: F.concat_ws(":", s["label"], s["first_word"].cast("string"), s["last_word"].cast("string"))),
            ",",
        ).alias("spans"),
    )
