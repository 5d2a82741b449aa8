"""License scans: MinHash bands over overlapping windows of words.

A template is the set of its shingles (five words; a shorter template is one
shingle). Texts are cut into overlapping windows sized to the templates: any run
as long as a template lies whole in one window. A window's MinHash bands are the
least and greatest of its shingles' hashes under several permutations; a window
that shares a band with a template is a candidate, and the share of the template's
shingles that the window holds is then counted exactly.

The number of bands is set so that a window that holds ``least`` of a template is
found with probability ``RECALL`` or more. Where ``least`` of a template is all of
it (four shingles or fewer), windows are as long as the template and stand at every
word, and one band finds every match for certain.

A text without any of a template's first shingles, of which ``least`` can miss all but
one, cannot match it. So a text goes on only if it holds one of a few telling words, one
of each such shingle at least, and bands are made for the templates that it may match.

DataFrame functions only. The templates are literals of the plan's small side.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import BETWEEN, words_of

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program"


def _cc(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License."


def _cc_text(name: str) -> str:
    return f'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License ("Public License").'


#: Short notices, the standard headers and texts of common licenses, and
#: openings of long ones. Headers also stand at the end of the full texts of Apache, GPL
#: and MPL.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause-text", _BSD + _BSD_AS_IS),
    ("bsd-3-clause-text", _BSD + _BSD3 + _BSD_AS_IS),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl-2.0-header", _gnu("General Public License", "2")),
    ("gpl-3.0-header", _gnu("General Public License", "3")),
    ("lgpl-2.1-header", _gnu("Lesser General Public License", "2.1")),
    ("lgpl-3.0-header", _gnu("Lesser General Public License", "3")),
    ("agpl-3.0-header", _gnu("Affero General Public License", "3")),
    ("gpl-2.0-text", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("gpl-3.0-text", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("lgpl-3.0-text", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *((f"cc-{i}-4.0-notice", _cc(n)) for i, n in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"))),
    *((f"cc-{i}-4.0-text", _cc_text(n)) for i, n in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"))),
)

SHINGLE = 5
LEAST = 0.8
RECALL = 0.999
_CELLS = "array<struct<shape:int,at:int,j:int,v:bigint>>"


@dataclass(frozen=True)
class Shape:
    """Windows for templates of one size: k words a shingle, m shingles a template,
    ``width`` shingles a window, a window every ``stride``, and so many bands."""

    k: int
    m: int
    width: int
    stride: int
    bands: int


def shape(n_words: int, least: float = LEAST, shingle: int = SHINGLE) -> Shape:
    k = min(shingle, n_words)
    m = n_words - k + 1
    need = math.ceil(least * m - 1e-9)
    if need == m:
        return Shape(k, m, m, 1, 1)
    stride = max(1, m // 2)
    width = m + stride - 1
    jaccard = need / (m + width - need)
    return Shape(k, m, width, stride, 2 * math.ceil(math.log(1 - RECALL) / math.log(1 - jaccard) / 2))


def _permuted(j: int):
    return lambda h: F.xxhash64(F.lit(j), h)


def _cell(shape: int, at: Column, j: int, v: Column) -> Column:
    return F.struct(F.lit(shape).alias("shape"), at.alias("at"), F.lit(j).alias("j"), v.alias("v"))


def _cells(s: Shape, number: int, grams: Column, permuted: list[Column]) -> Column:
    """The bands of all windows of one shape."""
    if s.bands == 1 and s.width == 1:
        return F.transform(grams, lambda h, i: _cell(number, i + 1, 0, h))
    starts = F.sequence(F.lit(1), F.greatest(F.size(grams) - s.m + 1, F.lit(1)), F.lit(s.stride))
    if s.bands == 1:
        cells = F.transform(starts, lambda i: _cell(number, i, 0, F.array_min(F.slice(grams, i, s.width))))
    else:
        cells = F.flatten(F.transform(starts, lambda i: F.array(*[_cell(number, i, j, b) for j, b in enumerate(_bands(permuted, i, s.width, s.bands))])))
    return F.when(F.size(grams) > 0, cells).otherwise(F.slice(cells, 1, 0))


def _bands(permuted: list[Column], start: Column, width: int, bands: int) -> list[Column]:
    """Band j of the window at start: least (even j) or greatest (odd j) of a permutation."""
    return [(F.array_max if j % 2 else F.array_min)(F.slice(permuted[j // 2], start, width)) for j in range(bands)]


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles; the incomplete ones at the end are cut off."""
    all_ = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(all_, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def telling_words(few: list[tuple[str, ...]]) -> list[str]:
    """Words, as few and as long as may be, of which each of these shingles holds one."""
    out, left = [], set(few)
    while left:
        count: dict[str, int] = {}
        for gram in left:
            for w in set(gram):
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (count[w] * max(len(w) - 4, 0.01), w))
        out.append(best)
        left = {gram for gram in left if best not in gram}
    return out


def matches(documents: DataFrame, templates=TEMPLATES, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """documents: doc_id, text. A row per distinct (doc_id, text) and template that one of its
    windows holds ``least`` of: doc_id, license_id, containment (the most of any window),
    start (first word of the first such window), n_windows and text_hash. Null and empty
    texts match nothing, templates without words are left out, repeated rows count once, a
    null doc_id is an id like others, and other columns are dropped."""
    spark = documents.sparkSession
    rows = spark.createDataFrame(list(templates), "license_id string, text string").dropDuplicates()
    table = [(r["license_id"], r["w"]) for r in rows.select("license_id", words_of(F.col("text"), BETWEEN).alias("w")).collect() if r["w"]]
    shapes = sorted({shape(len(w), least, shingle) for _, w in table}, key=lambda s: (s.k, s.m))
    ks = sorted({s.k for s in shapes})
    if not shapes:
        none = F.lit(None)
        return documents.limit(0).select("doc_id", none.cast("string").alias("license_id"), none.cast("double").alias("containment"), none.cast("int").alias("start"), none.cast("long").alias("n_windows"), none.cast("long").alias("text_hash"))
    first: list[tuple[str, ...]] = []
    for _, w in table:
        s = shape(len(w), least, shingle)
        grams = list(dict.fromkeys(zip(*(w[i:] for i in range(s.k)), strict=False)))
        first += grams[: len(grams) - max(1, math.ceil(least * len(grams) - 1e-9)) + 1]
    # lower() changes more letters than A-Z, so only runs of ASCII are looked for in what it
    # gives; the row of a generator holds it, else it would move into each condition
    text = documents.select("doc_id", F.col("text").cast("string").alias("_t")).where(F.col("_t").isNotNull())
    text = text.select("doc_id", F.inline(F.array(F.struct("_t", F.lower("_t").alias("_low")))))
    told = F.lit(False)
    for w in telling_words(first):
        told = told | F.contains("_low", F.lit(max(re.findall(r"[\x00-\x7F]*", w), key=len)))
    docs = text.where(told).select("doc_id", F.xxhash64("_t").alias("_h"), words_of(F.col("_t"), BETWEEN).alias("_w"))
    perms = {k: max(-(-s.bands // 2) for s in shapes if s.k == k) if any(s.bands > 1 for s in shapes if s.k == k) else 0 for k in ks}

    def hashed(df: DataFrame, keep: list[str]) -> DataFrame:
        """Adds the shingle hashes, an array a size."""
        return df.select(*keep, "_w", *[_grams(F.col("_w"), k).alias(f"_g{k}") for k in ks])

    def permuted() -> list[Column]:
        return [F.transform(f"_g{k}", _permuted(j)).alias(f"_g{k}_{j}") for k in ks for j in range(perms[k])]

    def made(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
        """Makes the columns once: they pass a generator, else they would move into the
        filters and lambdas that use them."""
        rest = [c for c in df.columns if c not in keep]
        return df.select(*keep, F.inline(F.array(F.struct(*rest, *columns))))

    def own_arrays(s: Shape) -> list[Column]:
        return [F.col(f"_g{s.k}_{j}") for j in range(perms[s.k])]

    def banded(df: DataFrame, keep: list[str], wanted_only=lambda n, cells: cells) -> DataFrame:
        """A row per window and band: keep, shape, at (first word), j, v."""
        parts = [wanted_only(n, _cells(s, n, F.col(f"_g{s.k}"), own_arrays(s))) for n, s in enumerate(shapes)]
        return df.select(*keep, "_w", F.explode_outer(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("c")).select(*keep, "_w", "c.*")

    wanted = spark.createDataFrame([(a, w, shapes.index(shape(len(w), least, shingle))) for a, w in table], "license_id string, _w array<string>, own int")
    wanted = hashed(wanted, ["license_id", "own"])
    keys = banded(wanted.select("*", *permuted()), ["license_id", "own"]).where("shape = own and at = 1")
    keys = keys.select("license_id", F.col("_w").alias("t"), F.col("shape").alias("s"), F.col("j").alias("jj"), F.col("v").alias("vv")).distinct()
    values = {r["s"]: r["v"] for r in keys.groupBy("s").agg(F.sort_array(F.collect_set("vv")).alias("v")).collect()}
    # a match holds ``least`` of a template's distinct shingles, so at least one of the first few
    few: dict[int, set[int]] = {n: set() for n in range(len(shapes))}
    for row in wanted.collect():
        grams = list(dict.fromkeys(row[f"_g{shapes[row['own']].k}"]))
        few[row["own"]].update(grams[: len(grams) - max(1, math.ceil(least * len(grams) - 1e-9)) + 1])

    def holds(k: int, hashes: set[int]) -> Column:
        return F.coalesce(F.arrays_overlap(f"_g{k}", F.array(*map(F.lit, sorted(hashes)))), F.lit(False))

    def wanted_only(n: int, cells: Column) -> Column:
        found = F.filter(cells, lambda c: c["v"].isin(values.get(n, [])))
        return F.when(F.col(f"_may{n}"), found).otherwise(F.array().cast(_CELLS))

    any_ = F.lit(False)
    for k in ks:
        any_ = any_ | holds(k, set().union(*(few[n] for n, s in enumerate(shapes) if s.k == k)))
    full = made(hashed(docs, ["doc_id", "_h"]), ["doc_id", "_h"], any_.alias("_any")).where("_any")
    full = made(full, ["doc_id", "_h"], *permuted(), *[holds(s.k, few[n]).alias(f"_may{n}") for n, s in enumerate(shapes)])
    cells = banded(full, ["doc_id", "_h"], wanted_only)
    met = cells.join(F.broadcast(keys), (F.col("v") == F.col("vv")) & (F.col("shape") == F.col("s")) & (F.col("j") == F.col("jj")))  # a few bands per template
    reach = F.element_at(F.array(*[F.lit(s.width + s.k - 1) for s in shapes]), F.col("shape") + 1)
    size = F.element_at(F.array(*[F.lit(s.k) for s in shapes]), F.col("shape") + 1)
    near = met.select("doc_id", "_h", "license_id", F.col("at"), F.slice("_w", F.col("at"), reach).alias("window"), F.col("t"), size.alias("k")).distinct()

    def shingles(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - F.col("k") + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.col("k")))))

    near = near.withColumn("a", shingles(F.col("t"))).withColumn("b", shingles(F.col("window")))
    share = F.size(F.array_intersect("a", "b")) / F.size("a")
    good = near.select("doc_id", "_h", "license_id", "at", share.alias("share")).where(F.col("share") >= least)
    best = F.max(F.struct(F.col("share"), (-F.col("at")).alias("back")))
    out = good.groupBy("doc_id", "_h", "license_id").agg(best.alias("best"), F.countDistinct("at").alias("n_windows"))
    return out.select("doc_id", "license_id", F.col("best.share").alias("containment"), (-F.col("best.back") - 1).cast("int").alias("start"), "n_windows", F.col("_h").alias("text_hash"))
