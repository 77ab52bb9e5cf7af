"""License scans: passages of a document against licence templates by the Dice coefficient over word bigrams.

A text is lower-cased (ASCII) and everything but ASCII letters and digits parts words, line ends like any other, so a
notice is found wrapped over lines, inside a longer line, and as a whole licence. A passage is a window over the whole
sequence of word bigrams that begins at a bigram of the template and is three quarters, once, or nine eighths as long as
the template (cut off where the text ends). Its set of bigrams is compared to the template's:
Dice = 2 |A & B| / (|A| + |B|) can reach t only if |A| and |A & B| are at least t/(2-t) |B| and |A| is at most (2-t)/t |B|.

So three bounds prune, and lose nothing. A template is tried only on texts that contain one of its anchors, words that
stand in more of its bigrams than a match can lack. A window is looked at only if enough bigrams of the template stand
in it, told from their positions alone. And only sets of fitting size are compared.

All of it is DataFrame code inside one row, so nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Names, public notices and whole texts of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "Apache-2.0-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[^0-9a-z]+", text.translate({k: k + 32 for k in range(65, 91)})) if w]


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def widths(length: int) -> list[int]:
    """How many bigrams a window has, for a template of so many in a row."""
    return sorted({max(1, 3 * length // 4), length, 9 * length // 8 + 1})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The sizes a set can have and still reach the threshold against one of this size, in exact thousandths."""
    t = round(threshold * 1000)
    return -(-t * size // (2000 - t)), (2000 - t) * size // t


#: Words that most texts hold; they are anchors only where nothing else is left. A matter of speed alone.
FREQUENT = frozenset("a an and any as at be by for from in is it not of on or that the this to under with you".split())


def anchors(grams: list[str], threshold: float) -> list[str]:
    """Words that stand in more of the distinct bigrams than a match can lack, so one stands in any match: the longest first,
    frequent ones last."""
    grams = sorted(set(grams))
    lacking = len(grams) - bounds(len(grams), threshold)[0]
    out, met = [], set()
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in FREQUENT, -len(w), w)):
        if len(met) > lacking:
            break
        out.append(w)
        met.update(g for g in grams if w in g.split())
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """For each row: doc_id, n_lines, license_id and dice of its best passage, line_no (from 0) and word_no (from 0, in the whole
    text) of the passage's first word, licenses (all that some passage reaches).

    Ties go to the earlier passage, then to the template first by code point. Without a match license_id, dice, line_no
    and word_no are null and licenses is empty. Null text has no line (n_lines 0), empty text has one. Templates of under
    two words have no bigrams and never match. Repeated rows are scanned each on their own; a very long text is scanned
    whole; no rows in: no rows out. Other columns are not read.
    """
    rows = {k: g for k, t in sorted((TEMPLATES if templates is None else templates).items()) if (g := bigrams(template_words(t)))}
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lower(F.col(text_col).cast("string")).alias("low"))
    found = "array<struct<minus:double,word:int,id:string>>"
    has = {k: anchors(g, threshold) for k, g in rows.items()}
    every = sorted({w for own in has.values() for w in own})
    # which anchors the text contains; a text without any is done
    chosen = chosen.withColumn("seen", F.array_compact(F.array(*[F.when(F.contains("low", F.lit(w)), F.lit(w)) for w in every]).cast("array<string>")))
    lines = F.split("text", "\n", -1)
    worded = F.flatten(F.transform(lines, lambda x, i: F.transform(F.filter(F.split(x, "[^0-9A-Za-z]+"), lambda w: w != ""), lambda w: F.struct(F.lower(w).alias("w"), i.alias("i")))))
    chosen = chosen.withColumn("n_lines", F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)))
    chosen = chosen.withColumn("words", F.when(F.size("seen") > 0, worded).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    many = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, many), F.slice("words", 2, many), lambda a, b: F.concat_ws(" ", a["w"], b["w"]))
    chosen = chosen.withColumn("grams", pairs).select("doc_id", "n_lines", "seen", "words", "grams")

    def hits(k: str, sequence: list[str]) -> Column:
        distinct = sorted(set(sequence))
        least, most = bounds(len(distinct), threshold)
        own = F.array(*map(F.lit, distinct))
        at = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(own, g), i)), lambda i: i.isNotNull())
        # from each place of a bigram: does the one that makes enough of them lie within the widest window
        enough = lambda p: F.filter(F.transform(p, lambda i, j: F.when(F.coalesce(F.get(p, j + least - 1) - i < max(widths(len(sequence))), F.lit(False)), i)), lambda i: i.isNotNull())
        starts = F.element_at(F.transform(F.array(at), enough), 1)

        def compared(i: Column) -> Column:
            sets = F.transform(F.array(*[F.array_distinct(F.slice("grams", i + 1, w)) for w in widths(len(sequence))]), lambda b: F.struct(
                (F.size(F.array_intersect(b, own)) * -2.0 / (F.size(b) + len(distinct))).alias("minus"), F.size(b).alias("n")))
            fit = F.filter(sets, lambda x: x["n"].between(least, most) & (x["minus"] <= -threshold))
            return F.transform(fit, lambda x: F.struct(x["minus"].alias("minus"), i.alias("word"), F.lit(k).alias("id")))

        return F.when(F.arrays_overlap("seen", F.array(*map(F.lit, has[k]))), F.flatten(F.transform(starts, compared))).otherwise(F.array().cast(found))

    r = chosen.withColumn("hits", F.array_sort(F.flatten(F.array(*[hits(k, g) for k, g in rows.items()]))) if rows else F.array().cast(found))
    r = r.withColumn("best", F.try_element_at("hits", F.lit(1)))
    licenses = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["id"])))
    return r.select("doc_id", "n_lines", F.col("best.id").alias("license_id"), (-F.col("best.minus")).alias("dice"), F.get("words", F.col("best.word"))["i"].alias("line_no"), F.col("best.word").alias("word_no"), licenses.alias("licenses"))


def oracle() -> str:
    """The same in SQL, over every window that begins at a bigram of the template, without bounds."""
    rows = {k: g for k, t in TEMPLATES.items() if (g := bigrams(template_words(t)))}
    grams = ", ".join(f"('{k}', '{b}')" for k, g in rows.items() for b in sorted(set(g)))
    sizes = ", ".join(f"('{k}', {len(set(g))}, {w})" for k, g in rows.items() for w in widths(len(g)))
    return rf"""
WITH t(id, g) AS (VALUES {grams}), z(id, m, width) AS (VALUES {sizes}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS x, unnest(range(len(lines))) AS line FROM d),
u AS (SELECT r, line, unnest(w) AS w, unnest(range(len(w))) AS k FROM (
  SELECT r, line, list_filter(regexp_split_to_array(x, '[^0-9A-Za-z]+'), lambda y: y <> '') AS w FROM l)),
w AS (SELECT r, line, lower(w) AS w, row_number() OVER (PARTITION BY r ORDER BY line, k) - 1 AS word FROM u),
g AS (SELECT r, line, word, w || ' ' || lead(w) OVER (PARTITION BY r ORDER BY word) AS g FROM w QUALIFY lead(w) OVER (PARTITION BY r ORDER BY word) IS NOT NULL),
s AS (SELECT g.r, g.word, g.line, z.id, z.m, z.width FROM g JOIN t USING (g) JOIN z USING (id)),
h AS (SELECT s.r, s.word, any_value(s.line) AS line, s.id, s.width, 2.0 * count(DISTINCT t.g) / (count(DISTINCT x.g) + any_value(s.m)) AS dice
      FROM s JOIN g x ON x.r = s.r AND x.word BETWEEN s.word AND s.word + s.width - 1 LEFT JOIN t ON t.id = s.id AND t.g = x.g
      GROUP BY s.r, s.word, s.id, s.width HAVING dice >= {THRESHOLD}),
b AS (SELECT r, arg_min(id, ROW(-dice, word, id)) AS license_id, max(dice) AS dice, arg_min(line, ROW(-dice, word, id)) AS line_no, min(ROW(-dice, word)) AS at, list_sort(list(DISTINCT id)) AS licenses FROM h GROUP BY r)
SELECT doc_id, coalesce(len(lines), 0)::INTEGER AS n_lines, license_id, dice, line_no::INTEGER AS line_no,
       (SELECT min(word) FROM h WHERE h.r = d.r AND h.dice = b.dice)::INTEGER AS word_no, coalesce(licenses, []) AS licenses
FROM d LEFT JOIN b USING (r)"""
