"""License scans with built-in functions only: Dice coefficient over word bigrams against licence templates.

What is compared is a text's lines, the text as a whole, and its windows of as many words as a template has, wherever lines break. All are
normalised to words and taken as bags of bigrams. A unit of a bigrams and a template of b reach a coefficient t only if
t / (2 - t) * b <= a <= (2 - t) / t * b, so word counts rule out most units, and only if they share t / (2 - t) * b bigrams at least: so a text without
any word of a set that more than the rest of the template's bigrams hold cannot have it, and most texts are ruled out by their words alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Least coefficient, and the templates (fixed values: public notices).
LEAST = 0.8
#: Words of everyday English, which tell little of a licence.
COMMON = frozenset("a all and any are as at be but by for from has have if in is it its may no not of on or other so such that the this to under use was which will with without you your".split())
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-file": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "reserved": "All rights reserved.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,
or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to
use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and
must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def words_of(template: str) -> list[str]:
    return re.findall(r"[^\W_]+", template.lower())


def bigrams_of(words: list[str]) -> Counter:
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def size_bounds(n: int, least: float = LEAST) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the coefficient with a template of n."""
    return math.ceil(least / (2 - least) * n - 1e-9), math.floor((2 - least) / least * n + 1e-9)


def telling(words: list[str], least: float = LEAST) -> list[str]:
    """Words of a template of which every unit that reaches the coefficient has one: uncommon and long ones first, until they touch all bigrams but those that a unit needs."""
    n, chosen, touched = len(words) - 1, [], set()
    for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
        if n - len(touched) < size_bounds(n, least)[0]:
            break
        chosen.append(w)
        touched |= {i for i in range(n) if w in words[i : i + 2]}
    return sorted(chosen)


def needed(words: list[str], least: float = LEAST) -> int:
    """How many different words of a template every unit that reaches the coefficient has: each bigram that it shares takes two, and a word is in so many bigrams at most."""
    n = len(words) - 1
    left, count = 2 * size_bounds(n, least)[0], 0
    for t in sorted((sum((i > 0) + (i < n) for i, x in enumerate(words) if x == w) for w in set(words)), reverse=True):
        if left <= 0:
            break
        left, count = left - t, count + 1
    return count


def grams(words: Column) -> Column:
    return F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat(F.get(words, i), F.lit(" "), x))


def bags(text: Column, low: int, high: int) -> Column:
    """array<array<string>>: the bigrams of the units (lines, and all of them) of a text that have low to high of them."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    # Runs of other characters became one blank, so trimmed lines, and filled lines joined by blanks, have one blank fewer than words.
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda u: F.trim(u)), lambda u: u != "")
    whole = lambda x: F.concat(x, F.when(F.size(x) > 1, F.array(F.array_join(x, " "))).otherwise(F.array().cast("array<string>")))
    units = F.get(F.transform(F.array(lines), whole), F.lit(0))  # an array of one binds the lines
    blanks = lambda u: F.length(u) - F.length(F.translate(u, " ", ""))
    split = F.transform(F.filter(units, lambda u: blanks(u).between(low, high)), lambda u: F.split(u, " "))
    return F.transform(split, grams)


def windows(all_grams: Column, template: Counter, least: float = LEAST) -> Column:
    """array<array<string>>: the windows, of as many bigrams as the template has or as are left, that can reach the coefficient.

    A best window starts with one of the template's bigrams, and so many of its bigrams have to be the template's: the
    place of the last one that it needs tells whether it can.
    """
    n = sum(template.values())
    places = F.filter(F.transform(all_grams, lambda g, i: F.when(g.isin(*sorted(template)), i)), lambda i: i.isNotNull())
    need = lambda i: F.ceil(F.lit(least) * (F.least(F.lit(n), F.size(all_grams) - i) + n) / 2 - F.lit(1e-9)).cast("int")
    starts = F.transform(F.array(places), lambda p: F.filter(F.transform(p, lambda i, k: F.when(F.get(p, k + need(i) - 1) < i + n, i)), lambda i: i.isNotNull()))
    return F.transform(F.get(starts, F.lit(0)), lambda i: F.slice(all_grams, i + 1, n))


def coefficient(bag: Column, template: Counter) -> Column:
    """Dice coefficient of a bag of bigrams with a template's."""
    shared = F.size(F.array_intersect(bag, F.lit(sorted(template)))).cast("double")
    if often := {g: n for g, n in template.items() if n > 1}:
        some = F.filter(bag, lambda x: x.isin(*sorted(often)))
        have = lambda own, gram: F.size(F.filter(own, lambda x: x == gram))
        more = lambda own: sum((F.greatest(F.lit(0), F.least(have(own, g), F.lit(n)) - 1) for g, n in often.items()), F.lit(0))
        shared = shared + F.get(F.transform(F.array(some), more), F.lit(0))
    return F.lit(2.0) * shared / (F.size(bag) + F.lit(sum(template.values())))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, score, found) for every row of docs.

    found lists, in the templates' order, each template that a line, the whole text or a window of the template's number of words (or of the
    words that are left) reaches `least` with, and its best coefficient; license and score are those of the best, the earlier template among equals, and null
    without any. A null or empty text has none. Templates need two words. Rows are judged one by one and other columns are ignored.
    """
    spelt = {k: words_of(t) for k, t in templates.items()}
    known = {k: bigrams_of(w) for k, w in spelt.items()}
    sized = {k: size_bounds(sum(b.values()), least) for k, b in known.items()}
    signs = {k: telling(w, least) for k, w in spelt.items()}
    own = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(F.lower(own), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    empty = F.array().cast("array<struct<license: string, score: double>>")
    every = sorted({w for x in signs.values() for w in x})
    # Lambdas bind what is used more than once, whatever the optimizer does with the columns. Most texts have none of the telling words; of
    # those that have, most lack some of those that a template needs.
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    enough = lambda w, k: F.arrays_overlap(w, F.lit(signs[k])) & (F.size(F.array_intersect(w, F.lit(sorted(set(spelt[k]))))) >= needed(spelt[k], least))

    def best(r, i, k):
        fits = F.concat(F.filter(r["bags"], lambda b: F.size(b).between(*sized[k])), windows(r["grams"], known[k], least))
        return F.when(F.get(r["may"], F.lit(i)), F.array_max(F.transform(fits, lambda b: coefficient(b, known[k]))))

    def scored(r):
        rows = F.array(*(F.struct(F.lit(k).alias("license"), F.round(best(r, i, k), 6).alias("score")) for i, k in enumerate(known)))
        return F.filter(rows, lambda x: x["score"] >= F.lit(least - 1e-9))

    def compared(w, may):
        units = bags(own, min(s[0] for s in sized.values()), max(s[1] for s in sized.values()))
        return F.when(F.exists(may, lambda x: x), bind(F.struct(units.alias("bags"), grams(w).alias("grams"), may.alias("may")), scored)).otherwise(empty)

    found = bind(words, lambda w: F.when(F.arrays_overlap(w, F.lit(every)), bind(F.array(*(enough(w, k) for k in known)), lambda may: compared(w, may))).otherwise(empty))
    rows = docs.select(F.col(doc_id).alias("doc_id"), found.alias("found"))
    score = F.array_max(F.transform("found", lambda x: x["score"]))
    return rows.select("doc_id", F.get(F.filter("found", lambda x: x["score"] == score), F.lit(0))["license"].alias("license"), score.alias("score"), "found")


def op8_license_scan(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "license", "score", F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"))


def _values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(k)}, {quoted(t)})" for i, (k, t) in enumerate(TEMPLATES.items()))


SQL = {
    "op8_license_scan": rf"""
WITH t(ord, license, body) AS (VALUES {_values()}),
tw AS (SELECT ord, license, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM t),
tb AS (SELECT ord, license, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tw),
tc AS (SELECT ord, license, n, gram, count(*) AS c FROM tb GROUP BY ALL),
units AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL UNION ALL
    SELECT doc_id, replace(text, chr(10), ' ') FROM documents WHERE contains(text, chr(10))),
uw AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(lower(unit), '[\p{{L}}\p{{N}}]+') AS w FROM units),
ub AS (SELECT u, doc_id, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM uw WHERE len(w) BETWEEN 2 AND 500),
uc AS (SELECT u, doc_id, n, gram, count(*) AS c FROM ub GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, len(w) - 1 AS m, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM dw WHERE len(w) > 1),
hits AS (SELECT doc_id, ord, license, tc.n, m, pos, gram, c FROM dg JOIN tc USING (gram)),
full_enough AS (SELECT h.doc_id, h.ord, h.pos, least(h.n, h.m - h.pos + 1) AS a FROM hits h JOIN hits k ON k.doc_id = h.doc_id AND k.ord = h.ord AND k.pos BETWEEN h.pos AND h.pos + h.n - 1
    GROUP BY h.doc_id, h.ord, h.pos, h.n, h.m HAVING count(*) >= 0.8 * (least(h.n, h.m - h.pos + 1) + h.n) / 2 - 1e-9),
wc AS (SELECT f.doc_id, f.ord, f.pos, f.a, h.license, h.n, h.gram, h.c AS tc, count(*) AS c FROM full_enough f JOIN hits h ON h.doc_id = f.doc_id AND h.ord = f.ord AND h.pos BETWEEN f.pos AND f.pos + h.n - 1 GROUP BY ALL),
dice AS (SELECT doc_id, ord, license, 2.0::DOUBLE * sum(least(uc.c, tc.c)) / (uc.n + tc.n) AS score FROM uc JOIN tc USING (gram) GROUP BY u, doc_id, ord, license, uc.n, tc.n
    UNION ALL SELECT doc_id, ord, license, 2.0::DOUBLE * sum(least(c, tc)) / (a + n) FROM wc GROUP BY doc_id, ord, license, pos, a, n),
best AS (SELECT doc_id, ord, license, round(max(score), 6) AS score FROM dice GROUP BY ALL HAVING max(score) >= 0.8 - 1e-9),
top AS (SELECT doc_id, license, score FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1),
names AS (SELECT doc_id, string_agg(license, ',' ORDER BY ord) AS licenses FROM best GROUP BY doc_id)
SELECT d.doc_id, top.license, top.score, coalesce(names.licenses, '') AS licenses FROM documents d LEFT JOIN top USING (doc_id) LEFT JOIN names USING (doc_id)
""",
}
