"""Licence scans with DataFrame functions only.

Text is lower-cased and everything but letters and digits becomes a space; line breaks are kept to cut it into units.
A unit is a line, or a whole text of several lines, so that wrapped licence texts are one unit too. Units and
templates are sets of word bigrams (one word: that word), compared by Dice's coefficient 2|A and B| / (|A| + |B|). A coefficient of
``least`` needs |A| between |B| * least / (2 - least) and |B| * (2 - least) / least, so a unit meets only templates whose
size bounds hold its word count. Texts and then units without any of the words of which every match must have one are dropped before they are
cut and before bigrams are formed. Templates of LONG_WORDS words or more are also looked for inside longer texts, wrapped or not: in windows of
their length, an eighth of it apart, of texts that hold as many of a template's words as a match needs.

Defined results: null and wordless texts give no row; every line and whole text gives its best template at or
above ``least`` (ties: the first by name), every long template its best window (ties: the first); rows that repeat give their rows again; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.75
#: Templates of so many words are looked for inside texts, in windows of their length that start that part of it apart.
LONG_WORDS, STEPS = 30, 8
#: Words of so many letters are looked for alone; shorter ones tell little by themselves.
TELLING = 6

# Wording of public licence notices and short licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigram_set(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words[:1]))


def bounds(size: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams that a set can have to reach ``least`` against one of ``size``; exact in integers."""
    sizes = [n for n in range(1, 4 * size + 4) if 2 * min(n, size) >= least * (n + size)]
    return sizes[0], sizes[-1]


def _templates(least: float) -> list[tuple[str, list[str], int, int]]:
    out = []
    for name in sorted(TEMPLATES):
        grams = bigram_set(template_words(TEMPLATES[name]))
        out.append((name, grams, *bounds(len(grams), least)))
    return out


def long_templates(least: float) -> list[tuple[str, list[str], int, int]]:
    """(name, bigrams, words, step of the windows) of the templates that are looked for inside texts."""
    worded = [(name, template_words(TEMPLATES[name])) for name in sorted(TEMPLATES)]
    return [(name, bigram_set(w), len(w), len(w) // STEPS) for name, w in worded if len(w) >= LONG_WORDS]


def shared_telling_words(templates: list[list[str]], least: float) -> list[str]:
    """Words of which every match of one of the templates (as bigrams) has one: a match holds at least least / (2 - least) of
    a template's bigrams, and these words touch more than the others. Words that tell most templates at once are taken
    first, words of fewer than TELLING letters, frequent in other texts, only where nothing else is left."""
    left = [{tuple(g.split(" ")) for g in grams} for grams in templates]
    need = [int(len(grams) * (1 - least / (2 - least)) + 1e-9) + 1 for grams in templates]  # to touch: more than a match can lack
    chosen = []
    while any(n > 0 for n in need):
        worth = Counter()
        for grams, n in zip(left, need, strict=True):
            if n > 0:
                for word, k in Counter(w for g in grams for w in set(g)).items():
                    worth[word] += min(k, n) / n
        word = max(worth, key=lambda w: (len(w) >= TELLING, worth[w], w))
        chosen.append(word)
        for i, grams in enumerate(left):
            left[i] = {g for g in grams if word not in g}
            need[i] -= len(grams) - len(left[i])
    return chosen


def telling_words(grams: list[str], least: float) -> list[str]:
    return shared_telling_words([grams], least)


def possible(words: str, templates: list[list[str]], least: float) -> Column:
    """Whether a column of words can hold a match of one of the templates: it has a telling word, or a short one and as many
    of a template's words as a match needs."""
    chosen = shared_telling_words(templates, least)
    among = lambda some: F.array(*[F.lit(w) for w in some])
    telling = [w for w in chosen if len(w) >= TELLING]
    found = F.arrays_overlap(words, among(telling)) if telling else F.lit(False)
    for grams in templates:
        own = sorted({w for g in grams for w in g.split(" ")})
        if short := [w for w in own if w in chosen and w not in telling]:
            found |= F.arrays_overlap(words, among(short)) & (F.size(F.array_intersect(words, among(own))) >= fewest_words(grams, least))
    return found


def fewest_words(grams: list[str], least: float) -> int:
    """Fewest distinct words of a template that a match can have: k words stand in at most half of their places in bigrams."""
    places = Counter(w for g in grams for w in (g.split(" ") * 2)[:2])
    need, held = len(grams) * least / (2 - least) - 1e-9, 0
    for k, (_, n) in enumerate(places.most_common(), 1):
        held += n
        if held / 2 >= need:
            return k
    return len(places)


def _met(df: DataFrame, doc_id: str, text: str, templates: list[list[str]], least: float) -> DataFrame:
    """doc_id, lower-cased text (low) and words of texts that can hold a match of one of the templates."""
    # by way of generators, or conditions would form text and words anew for each use
    low = df.select(F.col(doc_id).alias("doc_id"), _once(F.struct(F.lower(F.col(text)).alias("low"))))
    words = F.split(F.trim(F.regexp_replace("low", r"[^a-z0-9]+", " ")), " ")
    return low.select("doc_id", "low", _once(F.struct(words.alias("words")))).where(possible("words", templates, least))


def _windows(df: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """The best window of every long template in every longer text; ties: the first."""
    known = long_templates(least)
    met = _met(df, doc_id, text, [grams for _, grams, _, _ in known], least)

    def best(name: str, grams: list[str], m: int, step: int) -> Column:
        n, wanted = F.size("words"), F.array(*[F.lit(g) for g in grams])
        own = F.array(*[F.lit(w) for w in sorted({w for g in grams for w in g.split(" ")})])
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0)), F.lit(step)), F.array(n - m)))

        cut = F.transform(starts, lambda s: F.struct((-s).alias("order"), F.slice("words", s + 1, F.lit(m)).alias("part")))
        sets = F.transform(cut, lambda x: F.struct(x["order"].alias("order"), _distinct_bigrams(x["part"]).alias("grams")))
        rated = F.transform(sets, lambda x: F.struct((2.0 * F.size(F.array_intersect(x["grams"], wanted)) / (F.size(x["grams"]) + len(grams))).alias("dice"), x["order"].alias("order"), F.lit(name).alias("license")))
        enough = F.size(F.array_intersect("words", own)) >= fewest_words(grams, least)
        return F.when((n > m) & enough, F.array_max(F.filter(rated, lambda x: x["dice"] >= least)))

    found = met.select("doc_id", F.explode(F.array(*[best(*t) for t in known])).alias("best")).where("best is not null")
    return found.select("doc_id", F.lit(-2).alias("line"), (-F.col("best.order")).alias("first_word"), F.col("best.license").alias("license"), F.round("best.dice", 9).alias("dice"))


def normalised(low: str) -> Column:
    """Of a lower-cased text, runs of other characters become one space, or one line break if they hold one."""
    return F.regexp_replace(F.regexp_replace(F.col(low), r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*", "\n")


def _distinct_bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def _once(value: Column) -> Column:
    """A struct's fields by way of a generator, so that later uses read them instead of computing them again."""
    return F.inline(F.array(value))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, line (from 0; -1: the whole text; -2: a window), first_word (of a window, else -1), license and dice of
    every unit that matches a template."""
    known = _templates(least)
    # repeated bigrams leave fewer distinct ones, so word counts have no upper bound of their own below that of a text
    fewest = min(low for _, _, low, _ in known)
    every = [grams for _, grams, _, _ in known]
    lines = _met(df, doc_id, text, every, least).select("doc_id", F.split(normalised("low"), "\n").alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("line"), F.array_join("lines", " ").alias("unit"))))
    each = F.transform("lines", lambda unit, i: F.struct(i.cast("int").alias("line"), unit.alias("unit")))
    units = lines.select("doc_id", F.inline(F.concat(F.coalesce(whole, F.array().cast("array<struct<line:int,unit:string>>")), each)))
    units = units.select("doc_id", "line", F.trim("unit").alias("unit")).where(F.length("unit") > 0)
    spaces = F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit("")))
    # a unit much longer than every template can match only if it repeats itself: decided on its distinct bigrams
    units = units.where(F.greatest(spaces, F.lit(1)) >= fewest)
    units = units.select("doc_id", "line", _once(F.struct(F.split("unit", " ").alias("words")))).where(possible("words", every, least))
    units = units.select("doc_id", "line", _once(F.struct(_distinct_bigrams(F.col("words")).alias("grams")))).withColumn("n", F.size("grams"))
    units = units.where(" OR ".join(f"n BETWEEN {low} AND {high}" for low, high in sorted({(low, high) for _, _, low, high in known})))

    def score(grams: list[str], low: int, high: int) -> Column:
        common = F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in grams])))
        return F.when(F.col("n").between(low, high), 2.0 * common / (F.col("n") + len(grams)))

    rated = F.array(*[F.struct(score(grams, low, high).alias("dice"), F.lit(-i).alias("order"), F.lit(name).alias("license")) for i, (name, grams, low, high) in enumerate(known)])
    best = F.array_max(F.filter(rated, lambda x: x["dice"] >= least))
    matched = units.select("doc_id", "line", _once(F.struct(best.alias("best")))).where("best is not null")
    units = matched.select("doc_id", "line", F.lit(-1).alias("first_word"), F.col("best.license").alias("license"), F.round("best.dice", 9).alias("dice"))
    return units.unionByName(_windows(df, doc_id, text, least))


def oracle_sql(least: float = LEAST) -> str:
    """The same rows in SQL, with an inverted index of the templates' bigrams."""
    grams = ", ".join(f"('{name}', '{g}')" for name, gs, _, _ in _templates(least) for g in gs)
    longer = ", ".join(f"('{name}', {m}, {step})" for name, _, m, step in long_templates(least))
    return f"""
WITH lines AS (
  SELECT row_number() OVER () AS row, doc_id,
         string_split(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), chr(10)) AS lines
  FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT row, doc_id, unnest(range(len(lines)))::INTEGER AS line, trim(unnest(lines)) AS unit FROM lines
  UNION ALL SELECT row, doc_id, -1, trim(array_to_string(lines, ' ')) FROM lines WHERE len(lines) > 1
), worded AS (
  SELECT row, doc_id, line, string_split(unit, ' ') AS w FROM units WHERE length(unit) > 0
), sets AS (
  SELECT row, doc_id, line, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM worded
), grams AS (SELECT row, doc_id, line, len(g) AS n, unnest(g) AS gram FROM sets),
templates(license, gram) AS (VALUES {grams}),
sizes AS (SELECT license, count(*) AS m FROM templates GROUP BY license),
scores AS (
  SELECT row, doc_id, line, license, 2.0::DOUBLE * count(*) / (n + m) AS dice
  FROM grams JOIN templates USING (gram) JOIN sizes USING (license) GROUP BY row, doc_id, line, license, n, m
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row, line ORDER BY dice DESC, license) AS place FROM scores WHERE dice >= {least}
), longer(license, m, step) AS (VALUES {longer}),
plain AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL
), spots AS (
  SELECT row, doc_id, license, m, w, unnest(list_distinct(list_append(range(0, len(w) - m + 1, step), len(w) - m))) AS s FROM plain JOIN longer ON len(w) > m
), windows AS (
  SELECT row, doc_id, license, s, list_distinct(list_transform(range(s + 1, s + m), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM spots
), window_grams AS (SELECT row, doc_id, license, s, len(g) AS n, unnest(g) AS gram FROM windows),
window_scores AS (
  SELECT row, doc_id, license, s, 2.0::DOUBLE * count(*) / (n + sizes.m) AS dice
  FROM window_grams JOIN templates USING (license, gram) JOIN sizes USING (license) GROUP BY row, doc_id, license, s, n, sizes.m
), best AS (
  SELECT *, row_number() OVER (PARTITION BY row, license ORDER BY dice DESC, s) AS place FROM window_scores WHERE dice >= {least}
)
SELECT doc_id, line, -1 AS first_word, license, round(dice, 9) AS dice FROM ranked WHERE place = 1
UNION ALL SELECT doc_id, -2, s::INTEGER, license, round(dice, 9) FROM best WHERE place = 1
"""
