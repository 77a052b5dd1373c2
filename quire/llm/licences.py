"""Licence scan in DataFrame operations: Dice coefficient over word bigrams.

A document's lines, its paragraphs of several lines and its whole text are
segments. A segment's distinct word bigrams are compared with those of each
licence template whose size allows the threshold: with a common bigrams at most
as many as the smaller side has, Dice >= t bounds the segment's size to
[t / (2 - t), (2 - t) / t] of the template's. These bounds make an equality
join on the segment's size; segments that no template can match are left out
before any bigram is made. Each segment goes to its best template.

The bounds prune templates for a whole document first: a part of it that matches
a template has at least t / (2 - t) of the template's bigrams. One pass over the
words keeps the documents that have so many of some template's; only those are
cut into segments.

With windows=True (op10_licences) licences that no segment of a document has are
also looked for in windows of its words, over paragraphs and within lines. Each
bigram of a template counts for a window and each other one against it, so that
the sum tells whether the window can reach the threshold; along the text, the
highest sums of each run of hits give its windows, whose Dice coefficient is then
taken exactly. A run ends where no window could go on: at a gap, or a length, that
the threshold forbids. Of windows that overlap the better one counts. Windows whose
licence has other bigrams many times over may be missed.

Defined results: null and empty texts match nothing; without templates of two words
or more nothing is found; ties between templates go to the licence first in the
alphabet; rows that repeat both doc_id and text count once; rows that repeat a
doc_id only are scanned each, and their segments added up; of rows without a doc_id
each text is a document of its own; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .staging import Stage

#: Dice coefficient that counts as a match, as NUM / DEN.
NUM, DEN = 80, 100

#: Names of licences in notices, by identifier.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "Apache-2.0": ("Apache License, Version 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
#: Phrasings of short notices; "the" goes before names but the abbreviations of Creative Commons licences.
PHRASES = (
    "Licensed under {the}{name}",
    "Released under {the}{name}",
    "Distributed under {the}{name}",
    "This work is licensed under {the}{name}",
    "This project is licensed under {the}{name}",
    "This software is released under the terms of {the}{name}",
)
#: Longer texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN
NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received
a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin
Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You
should have received a copy of the GNU Lesser General Public License along with this library. If not, see
https://www.gnu.org/licenses/""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You
should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You
should have received a copy of the GNU Affero General Public License along with this program. If not, see
https://www.gnu.org/licenses/""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
}


def templates() -> list[tuple[str, str]]:
    """(licence, normalised words joined by blanks)."""
    out = [(k, p.format(the="" if name.startswith("CC ") else "the ", name=name)) for k, names in NAMES.items() for name in names for p in PHRASES]
    out += list(TEXTS.items())
    return [(k, " ".join(re.findall("[a-z0-9]+", t.lower()))) for k, t in out]


def _bounds(n: int, num: int, den: int) -> tuple[int, int]:
    """Sizes of segments that can match a template of n bigrams."""
    return -(-num * n // (2 * den - num)), n * (2 * den - num) // num


def _bigrams(words: Column) -> Column:
    """Hashes of the distinct word bigrams."""
    n = F.size(words) - 1
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def segments(docs: DataFrame, low: int, high: int) -> DataFrame:
    """doc_id, key, segment (its number), bigrams: of all segments that may have between low and high distinct bigrams.

    A segment of w words, d of them distinct, has at most w - 1 and at least d - 1 distinct bigrams.
    """
    text = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split("t", "\n")
    several = F.size(F.filter(lines, lambda x: F.trim(x) != "")) > 1
    whole = F.when(several, F.array("t")).otherwise(F.array().cast("array<string>"))
    paragraphs = F.filter(F.split("t", r"\n(?: *\n)+"), lambda x: F.contains(F.trim(F.lit("\n"), x), F.lit("\n")))
    some = F.when(F.rlike("t", F.lit(r"\n *\n")), paragraphs).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", "key", text.alias("t")).filter("t is not null").select("doc_id", "key", F.posexplode(F.concat(lines, some, whole)).alias("segment", "s"))
    words = rows.select("doc_id", "key", "segment", F.split(F.trim(F.regexp_replace("s", r"[ \n]+", " ")), " ").alias("w"))
    fits = (F.size("w") > low) & (F.size(F.array_distinct("w")) - 1 <= high)
    return words.filter(fits).select("doc_id", "key", "segment", _bigrams(F.col("w")).alias("bigrams"))


class Template(NamedTuple):
    licence: str
    grams: list[int]  # distinct
    words: int

    def least(self, num: int, den: int) -> int:
        """Bigrams of it that a match has at least."""
        return _bounds(len(self.grams), num, den)[0]

    def fields(self, num: int, den: int) -> dict:
        """m: distinct bigrams; need: sum of a window; most: its length; gap: others in a row."""
        m, long = len(self.grams), self.words - 1
        most = _bounds(long, num, den)[1]
        gap = most - -(-num * (most + long) // (2 * den))
        return {"licence": self.licence, "grams": self.grams, "m": m, "least": self.least(num, den), "need": num * m, "most": most, "gap": gap}


def _known(spark: SparkSession, known: list[tuple[str, str]]) -> list[Template]:
    """Templates with their bigrams' hashes; those without bigrams are left out."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(known)], "i long, licence string, words string")
    made = rows.select("i", "licence", F.split("words", " ").alias("w")).select("i", "licence", _bigrams(F.col("w")).alias("g"), F.size("w").alias("n")).orderBy("i").collect()
    return [Template(r.licence, r.g, r.n) for r in made if r.n > 1]


def _words(docs: DataFrame) -> DataFrame:
    """docs with g: hashes of its words' bigrams, in order."""
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ")
    n = F.size("w") - 1
    grams = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return docs.withColumn("w", w).filter(F.size("w") > 1).withColumn("g", grams).drop("w")


def _may_match(docs: DataFrame, table: list[Template], num: int, den: int) -> DataFrame:
    """The documents that have enough bigrams of some template, with g."""
    every = ", ".join(f"{g}L" for g in sorted({g for t in table for g in t.grams}))
    least = min(t.least(num, den) for t in table)
    # Within the outer array what it holds is made once; a column would be made again for each template.
    enough = lambda h: (F.size(h) >= least) & F.exists(_constant(table, num, den), lambda t: F.size(F.array_intersect(h, t["grams"])) >= t["least"])
    return _words(docs).filter(F.exists(F.array(F.expr(f"array_distinct(filter(g, x -> x IN ({every})))")), enough))


def _constant(table: list[Template], num: int, den: int) -> Column:
    """The templates as one constant, an array of structs."""
    rows = json.dumps([t.fields(num, den) for t in table])
    return F.from_json(F.lit(rows), "array<struct<licence:string,grams:array<long>,m:int,least:int,need:int,most:int,gap:int>>")


def _runs(places: Column, t: Column, num: int, den: int) -> Column:
    """Windows (a, b: first and last bigram) with the highest sums of the runs of a template's places in a text."""
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    zero = F.lit(0)
    start = F.struct(F.lit(-1).alias("last"), zero.alias("sum"), zero.alias("start"), zero.alias("best"), zero.alias("a"), zero.alias("b"), nothing.alias("out"))

    def ended(s: Column) -> Column:
        return F.when(s["best"] >= t["need"], F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        others = p - s["last"] - 1
        left = s["sum"] - F.lit(num) * others
        new = (s["last"] < 0) | (left <= 0) | (others > t["gap"]) | (p - s["start"] >= t["most"])
        total = F.when(new, 0).otherwise(left) + F.lit(2 * den - num)
        first = F.when(new, p).otherwise(s["start"])
        up = new | (total > s["best"])
        return F.struct(
            p.alias("last"), total.alias("sum"), first.alias("start"), F.when(up, total).otherwise(s["best"]).alias("best"),
            F.when(up, first).otherwise(s["a"]).alias("a"), F.when(up, p).otherwise(s["b"]).alias("b"), F.when(new, ended(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(places, start, step, ended)


def _windows(docs: DataFrame, table: list[Template], num: int, den: int) -> DataFrame:
    """doc_id, key, licence, dice: of the windows of each document (with g) that match; all of it within the row."""
    rows = docs.withColumn("t", F.filter(_constant(table, num, den), lambda t: F.size(F.array_intersect("g", t["grams"])) >= t["least"]))

    def of(t: Column) -> Column:
        at = F.filter(F.transform("g", lambda x, i: F.when(F.array_contains(t["grams"], x), i)), lambda i: i.isNotNull())

        def scored(w: Column) -> Column:
            x = F.array_distinct(F.slice("g", w["a"] + 1, w["b"] - w["a"] + 1))
            return F.struct(w["a"].alias("a"), w["b"].alias("b"), t["licence"].alias("licence"), F.size(F.array_intersect(x, t["grams"])).alias("c"), (F.size(x) + t["m"]).alias("total"))

        return F.transform(_runs(at, t, num, den), scored)

    found = rows.select("doc_id", "key", F.flatten(F.transform("t", of)).alias("ws"))
    found = found.select("doc_id", "key", F.filter("ws", lambda x: x["c"] * 2 * den >= x["total"] * num).alias("ws"))

    def worse(x: Column, y: Column) -> Column:
        better = y["c"] / y["total"]
        own = x["c"] / x["total"]
        return (y["a"] <= x["b"]) & (x["a"] <= y["b"]) & ((better > own) | ((better == own) & (y["licence"] < x["licence"])))

    kept = found.select("doc_id", "key", F.explode(F.filter("ws", lambda x: ~F.exists("ws", lambda y: worse(x, y)))).alias("x"))
    return kept.select("doc_id", "key", F.col("x.licence").alias("licence"), (F.col("x.c") * 2 / F.col("x.total")).alias("dice"))


RESULT = "doc_id long, licence string, dice double, n_segments long"


def scan_licences(spark: SparkSession, docs: DataFrame, known: list[tuple[str, str]] | None = None, num: int = NUM, den: int = DEN, windows: bool = False) -> DataFrame:
    """Per document and licence found: doc_id, licence, dice (best), n_segments (1 for a licence found in a window only)."""
    stage = Stage(spark, "licences")
    table = _known(spark, templates() if known is None else known)
    if not table:
        return spark.createDataFrame([], RESULT)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    docs = stage.write(_may_match(docs, table, num, den), "some")
    sizes = [_bounds(len(t.grams), num, den) for t in table]
    # Templates with the sizes of segments that they can match.
    fits = F.explode(_constant(table, num, den)).alias("t")
    span = F.sequence(F.floor((F.lit(num) * F.col("t.m") + (2 * den - num - 1)) / (2 * den - num)).cast("int"), F.floor(F.col("t.m") * (2 * den - num) / num).cast("int"))
    sized = spark.range(1).select(fits).select("t.licence", F.col("t.grams").alias("template"), "t.m", F.explode(span).alias("n"))
    found = segments(docs, min(a for a, _ in sizes), max(b for _, b in sizes))
    pairs = found.withColumn("n", F.size("bigrams")).join(sized, "n")
    common = F.size(F.array_intersect("bigrams", "template"))
    pairs = pairs.select("doc_id", "key", "segment", "licence", common.alias("c"), (F.col("n") + F.col("m")).alias("total")).filter(F.col("c") * 2 * den >= F.col("total") * num)
    dice = F.col("c") * 2 / F.col("total")
    best = pairs.groupBy("doc_id", "key", "segment").agg(F.min(F.struct((-dice).alias("d"), F.col("licence"))).alias("best"))
    # Rows without a doc_id are told apart by their texts.
    by = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("key")).alias("other"), F.col("licence")]
    out = best.select("doc_id", "key", F.col("best.licence").alias("licence"), (-F.col("best.d")).alias("dice")).groupBy(*by).agg(F.max("dice").alias("dice"), F.count("*").alias("n_segments"))
    if windows:
        more = _windows(docs, table, num, den).select("doc_id", by[1], "licence", "dice", F.lit(None).cast("long").alias("n_segments"))
        # What segments found stays as it is.
        dice = F.coalesce(F.max(F.when(F.col("n_segments").isNotNull(), F.col("dice"))), F.max("dice")).alias("dice")
        both = out.unionByName(more).groupBy("doc_id", "other", "licence").agg(dice, F.max("n_segments").alias("n"))
        out = both.select("doc_id", "licence", "dice", F.coalesce("n", F.lit(1).cast("long")).alias("n_segments"))
    return out.select("doc_id", "licence", "dice", "n_segments")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), windows=True)


def _sql() -> str:
    rows = ", ".join(f"('{k}', '{t}')" for k, t in templates())
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return rf"""
WITH tpl AS (SELECT licence, {grams} AS g FROM (SELECT licence, string_split(t, ' ') AS w FROM (VALUES {rows}) AS v(licence, t))),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, list_concat(string_split(t, chr(10)),
            CASE WHEN regexp_matches(t, '\n *\n') THEN list_filter(regexp_split_to_array(t, '\n(?: *\n)+'), lambda x: contains(trim(x, chr(10)), chr(10))) ELSE [] END,
            CASE WHEN len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) > 1 THEN [t] ELSE [] END) AS p FROM d),
seg AS (SELECT doc_id, i, string_split(trim(regexp_replace(p[i], '[ \n]+', ' ', 'g')), ' ') AS w FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
sg AS (SELECT doc_id, i, {grams} AS g FROM seg WHERE len(list_distinct(w)) <= 400 AND len(w) > 1),
m AS (SELECT doc_id, i, licence, 2.0::DOUBLE * len(list_intersect(sg.g, tpl.g)) / (len(sg.g) + len(tpl.g)) AS dice
      FROM sg, tpl WHERE 10 * len(sg.g) <= 15 * len(tpl.g) AND 15 * len(sg.g) >= 10 * len(tpl.g)),
best AS (SELECT doc_id, i, dice, licence, row_number() OVER (PARTITION BY doc_id, i ORDER BY dice DESC, licence) AS r FROM m WHERE dice >= 0.8)
SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_segments FROM best WHERE r = 1 GROUP BY doc_id, licence
"""


OP10_SQL = _sql()
