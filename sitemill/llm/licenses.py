"""License scans with DataFrame functions only: Dice coefficient over word bigrams against templates.

A document's units are its whole text, its paragraphs and its lines, and, for licences inside other text, the
windows of as many words as a template has that begin with a bigram of the template. A unit matches a template
if the Dice coefficient of their sets of word bigrams is at least the threshold t; then their sizes a, b satisfy
t / (2 - t) <= a / b <= (2 - t) / t, which prunes templates before bigrams are compared, and at least
t / (2 - t) of the template's bigrams are shared. So each template has some words that no match can be
without one of; texts that have none of any template's are left out before they are cut up. A window is
compared only where enough bigrams of the template follow its beginning closely enough.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

THRESHOLD = 0.8
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Licences with the wording of their texts, headers and usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
)


def normal(text: str) -> str:
    """ASCII letters in lower case and digits; whatever else stands between them is one space."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)).strip()


def bigrams(text: str) -> set[str]:
    w = normal(text).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def anchors(templates, threshold: float = THRESHOLD) -> list[str]:
    """Strings of which every unit that matches any template has at least one in a word.

    A match misses at most n - ceil(n * t / (2 - t)) of a template's n bigrams. Strings of 6 letters are
    chosen, that which is in most of the bigrams still wanted first, until more of each template's have one;
    templates of shorter words give whole words."""
    wanted = []
    for _, text in templates:
        own = bigrams(text)
        wanted.append([own, len(own) - math.ceil(len(own) * threshold / (2 - threshold) - 1e-9) + 1])
    chosen: list[str] = []
    while any(n > 0 and own for own, n in wanted):
        gain: dict[str, int] = {}
        for own, n in wanted:
            if n > 0:
                parts = [{w[k : k + 6] for w in b.split() for k in range(max(1, len(w) - 5))} for b in own]
                long = [{x for x in p if len(x) == 6} for p in parts]
                count: dict[str, int] = {}
                for p in long if any(long) else parts:
                    for x in p:
                        count[x] = count.get(x, 0) + 1
                for x, k in count.items():
                    gain[x] = gain.get(x, 0) + min(n, k)
        best = max(gain, key=lambda x: (gain[x], len(x), x))
        chosen.append(best)
        for x in wanted:
            has = {b for b in x[0] if best in b}
            x[0], x[1] = x[0] - has, x[1] - len(has)
    return sorted(chosen)


def _normal(c: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_units (different texts, paragraphs and lines of the document whose best template is one of its), dice (the best, windows included), a row for each document and licence found in it.

    A licence that only windows show has no unit of its own, n_units 0. Of templates that match a unit, or windows
    of one beginning, equally well, the first licence by name counts. Null and empty texts, and units of fewer than two words, match nothing; an empty table gives no rows;
    repeated rows are one document; columns besides doc_id and text are not read. Rows with a null id are
    one document. The templates are a constant of the plan, so nothing is broadcast or joined."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    names = sorted({name for name, _ in templates}, reverse=True)
    known = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(names.index(name)).alias("rank"), F.lit(len(b)).alias("n"), F.lit(len(normal(text).split()) - 1).alias("long"), F.lit(math.ceil(low * len(b) - 1e-9)).alias("least"), F.array(*map(F.lit, b)).alias("bigrams")) for name, text in templates if (b := sorted(bigrams(text)))))
    text = F.col("text").cast("string")
    some = F.lit(False)
    for part in anchors(templates, threshold):
        some = some | F.contains(F.lower("text"), F.lit(part))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(some)
    units = F.array_union(F.array("text"), F.array_union(F.split("text", r"\n\s*\n"), F.split("text", r"\n")))
    u = d.select("doc_id", F.explode(F.array_distinct(F.transform(units, _normal))).alias("unit")).select("doc_id", F.split("unit", " ").alias("w"))
    # before bigrams are made: as many words as give enough, and, where none repeats, not too many
    sizes = [len(bigrams(t)) for _, t in templates]
    u = u.where(F.size("w").between(2, 1 << 30) & (F.size("w") - 1 >= int(low * min(sizes))))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat(F.try_element_at("w", i), F.lit(" "), F.try_element_at("w", i + 1))))
    # explode of one element: what follows reads the bigrams instead of making them again for each template
    u = u.select("doc_id", "w", F.explode(F.array(pairs)).alias("b"))
    u = u.where((F.size("b") >= low * min(sizes) - 1e-9) & (F.size("b") <= high * max(sizes) + 1e-9))
    near = F.filter(known, lambda t: (t["n"] >= F.size("b") * low - 1e-9) & (t["n"] <= F.size("b") * high + 1e-9))
    best = F.array_max(F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect("b", t["bigrams"])) / (F.size("b") + t["n"])).alias("dice"), t["rank"].alias("rank"), t["license"].alias("license"))))
    found = u.select("doc_id", "w", F.explode(F.array(best)).alias("x")).where(F.col("x.dice") >= threshold)
    found = found.groupBy("doc_id", F.col("x.license").alias("license"), F.array_join("w", " ").alias("unit")).agg(F.max("x.dice").alias("dice"))
    found = found.unionByName(_windows(d, known, threshold))
    return found.groupBy("doc_id", "license").agg(F.count("unit").alias("n_units"), F.max("dice").alias("dice"))


def _windows(d: DataFrame, known: F.Column, threshold: float) -> DataFrame:
    """doc_id, license, unit (null), dice of the windows of texts (doc_id, text) that match, a row for each beginning and its best licence."""
    w = d.select("doc_id", F.xxhash64("text").alias("h"), F.explode(F.array(F.split(_normal(F.col("text")), " "))).alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.try_element_at("w", i), F.lit(" "), F.try_element_at("w", i + 1)))
    w = w.select("doc_id", "h", F.explode(F.array(pairs)).alias("b"))
    w = w.select("doc_id", "h", "b", F.explode(F.array(F.array_distinct("b"))).alias("own"))
    w = w.select("doc_id", "h", "b", F.explode(F.filter(known, lambda t: F.size(F.array_intersect("own", t["bigrams"])) >= t["least"])).alias("t"))
    hits = F.filter(F.sequence(F.lit(1), F.size("b")), lambda i: F.array_contains("t.bigrams", F.try_element_at("b", i)))
    w = w.select("doc_id", "h", "b", "t", F.explode(F.array(hits)).alias("at"))
    # the last of the bigrams that a match must have lies within the window
    begins = F.filter("at", lambda p, k: F.try_element_at("at", k + F.col("t.least")) < p + F.col("t.long"))
    w = w.select("doc_id", "h", "b", "t", F.explode(begins).alias("p"))
    w = w.select("doc_id", "h", "t", "p", F.explode(F.array(F.array_distinct(F.slice("b", F.col("p"), F.col("t.long"))))).alias("b"))
    w = w.withColumn("dice", 2.0 * F.size(F.array_intersect("b", "t.bigrams")) / (F.size("b") + F.col("t.n"))).where(F.col("dice") >= threshold)
    best = w.groupBy("doc_id", "h", "p").agg(F.max(F.struct("dice", F.col("t.rank").alias("rank"), F.col("t.license").alias("license"))).alias("x"))
    return best.select("doc_id", F.col("x.license").alias("license"), F.lit(None).cast("string").alias("unit"), F.col("x.dice").alias("dice"))


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB: every unit, and every window that begins with a bigram of a template, against the template."""
    rows = ", ".join(f"('{name}', '{normal(text)}')" for name, text in templates)
    return rf"""
WITH t AS (
  SELECT k, license, len(w) - 1 AS long, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT row_number() OVER () AS k, license, string_split(x, ' ') AS w FROM (VALUES {rows}) v(license, x)) WHERE len(w) > 1
), u AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS unit FROM (
    SELECT doc_id, text AS unit FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) FROM documents
    UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents)
), g AS (
  SELECT doc_id, unit, list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) AS b
  FROM (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM u) WHERE len(w) >= 2
), m AS (
  SELECT doc_id, license, unit, max(2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b))) AS dice FROM g, t
  WHERE len(g.b) + len(t.b) > 0 GROUP BY ALL
), f AS (
  SELECT text_id, doc_id, list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]) AS b FROM (
    SELECT row_number() OVER () AS text_id, doc_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL)
  WHERE len(w) >= 2
), hit AS (
  SELECT text_id, p, t.k FROM (SELECT text_id, unnest(b) AS x, generate_subscripts(b, 1) AS p FROM f) o JOIN (SELECT k, unnest(b) AS x FROM t) t USING (x)
), win AS (
  SELECT text_id, f.doc_id, p, license, 2.0::DOUBLE * len(list_intersect(list_distinct(f.b[p:p + long - 1]), t.b)) / (len(list_distinct(f.b[p:p + long - 1])) + len(t.b)) AS dice
  FROM hit JOIN f USING (text_id) JOIN t USING (k)
), every AS (
  SELECT doc_id, license, unit, dice FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1
  UNION ALL SELECT doc_id, license, NULL, dice FROM (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY text_id, p ORDER BY dice DESC, license) = 1)
)
SELECT doc_id, license, count(unit)::BIGINT AS n_units, max(dice) AS dice FROM every WHERE dice >= {threshold} GROUP BY ALL
"""
