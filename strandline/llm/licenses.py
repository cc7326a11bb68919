"""License scan by diagonal voting.

All rolling word 4-gram hashes of all documents are joined with the positions of the same hashes in
license templates. A hit votes for its diagonal, document position minus template position; votes are
counted by diagonal, neighbouring diagonals (an inserted or missing word) are merged, and the merged
span is verified by the share of the template's words that its hits cover when they are aligned: in the same order in text and template.

Scale. The templates are a fixed table, so the join is a broadcast one and only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.words import alnum_words

GRAM = 4
#: Diagonals this near belong to one span.
SHIFT = 3
COVERAGE = 0.7

# The phrases that always count, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# License texts and the notices that refer to them, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def _grams(h: str) -> str:
    picked = ", ".join(f"get({h}, i + {j})" for j in range(1, GRAM))
    return f"transform(slice({h}, 1, greatest(size({h}) - {GRAM - 1}, 0)), (w, i) -> xxhash64(w, {picked}))"


def template_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, template, label, first_word, last_word, votes, coverage) of every verified span of ``docs`` (doc_id, text).

    Null and empty texts and empty tables give none; rows that share a doc_id, null among them, are one text here as far as their hits go; very
    long texts are scanned whole; extra columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(TEMPLATES)], "template int, label string, text string")
    known = known.withColumn("h", F.transform(alnum_words(F.col("text")), lambda w: F.xxhash64(w))).withColumn("length", F.size("h"))
    known = known.select("template", "label", "length", F.posexplode(F.expr(_grams("h"))).alias("at", "gram"))
    rows = docs.select("doc_id", F.transform(alnum_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    # outer: from an inner generator the optimizer infers a filter that would rebuild the hashes for each element
    rows = rows.withColumn("grams", F.expr(_grams("h"))).select("doc_id", F.posexplode_outer("grams").alias("pos", "gram"))
    hits = rows.join(F.broadcast(known), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    keys = ["doc_id", "template", "label", "length"]
    votes = hits.groupBy(*keys, "diagonal").agg(F.count("*").alias("votes"), F.collect_list(F.struct("pos", "at")).alias("hits"))
    own = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > SHIFT, F.lit(True)).cast("int")
    votes = votes.withColumn("new", new).withColumn("span", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # at most as many hits as template words for each diagonal
    spans = votes.groupBy(*keys, "span").agg(F.sum("votes").cast("long").alias("votes"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.max_by("diagonal", "votes").alias("main"))
    # aligned words: hits are taken in document order while they go on in the template too, and each covers the words that none before covered
    start = "named_struct('pos', -1, 'at', -1, 'p', 0, 'a', 0, 'n', 0, 'lo', -1)"
    onward = "x.pos > s.pos AND x.at > s.at AND abs(x.pos - x.at - main) <= " + str(4 * SHIFT)
    fresh = f"cast(least({GRAM}, x.pos + {GRAM} - s.p, x.at + {GRAM} - s.a) as int)"
    step = f"named_struct('pos', x.pos, 'at', x.at, 'p', x.pos + {GRAM}, 'a', x.at + {GRAM}, 'n', s.n + {fresh}, 'lo', if(s.lo < 0, x.pos, s.lo))"
    spans = spans.withColumn("run", F.expr(f"aggregate(hits, {start}, (s, x) -> if({onward}, {step}, s))"))
    spans = spans.withColumn("coverage", F.col("run.n") / F.col("length")).filter(F.col("coverage") >= COVERAGE)
    spans = spans.withColumn("lo", F.col("run.lo")).withColumn("hi", F.col("run.pos"))
    return spans.select("doc_id", "template", "label", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + GRAM - 1).cast("long").alias("last_word"), "votes", "coverage")


def base_places(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places): where the words of the fixed phrases stand, as (start, label)."""
    rows = docs.select("doc_id", alnum_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    # the words are gone through only where the one that all phrases end with is among them
    rows = rows.withColumn("words", F.when(F.array_contains("words", "license"), F.col("words")))
    found = []
    for phrase, label in PHRASES:
        words = phrase.split(" ")
        same = " AND ".join(f"get(words, i + {j}) = '{w}'" for j, w in enumerate(words))
        found.append(f"filter(transform(words, (w, i) -> if({same}, named_struct('start', cast(i as long), 'label', '{label}'), NULL)), x -> x IS NOT NULL)")
    return rows.select("doc_id", "n_words", F.expr(f"array_sort(coalesce(concat({', '.join(found)}), array()))").alias("places"))


def license_scan(docs: DataFrame) -> DataFrame:
    """Fixed phrases and template spans of every row of ``docs`` (doc_id, text).

    n_base, first_word, last_word and base_labels are of the phrases; labels adds the templates
    verified, score is 1 with a phrase, else the best coverage, else 0. A null or empty text has no
    words: zeros, null places, empty labels; a very long one is gone through whole. Rows with a null doc_id get no template labels, rows that
    share a doc_id share them. Repeated rows come back each; extra columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select("doc_id", "text")
    spans = template_spans(docs.filter("doc_id IS NOT NULL"))
    spans = spans.groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"), F.count("*").alias("n_spans"))
    rows = base_places(docs).withColumn("base", F.expr("array_sort(array_distinct(transform(places, p -> p.label)))"))
    rows = rows.join(spans, "doc_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.expr("get(places, 0).start").alias("first_word"), F.expr("get(places, size(places) - 1).start").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )
