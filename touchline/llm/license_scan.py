"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A match of a template of ``t`` shingles is a stretch of ``2 t`` shingles of a text that holds at least 80 % of the template's. All is
built-in functions. Hashes of shingles stand for shingles. A text without any of a few words, of which every match must hold one, stops before
it is cut into words; one without any shingle of any template stops there. In the others, each size class cuts windows around the shingles of
its own templates. Windows have three sizes' worth of room for their templates: sizes double from class to
class, a window is twice its class and starts at every half of itself, so that a stretch of a template lies in one window.

Bands have one row. Where a window holds 80 % of its template, their Jaccard similarity is ``LEAST`` at least, and ``BANDS`` bands miss it with
probability ``(1 - LEAST) ** BANDS``, under one in ten thousand.

Known are short notices, the bodies and headers of ``BODIES``, and SPDX lines. Texts of one family differ in a few words: a place counts
for those that hold most there. 'All rights reserved' reserves rights and names no license.

Defined cases: a null or empty text has no license; templates shorter than a shingle are refused; rows with one key share their result;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.text import ascii_lower

SHINGLE, PERCENT = 5, 80
#: 0.8 t over a window of 4 t shingles at most and what the template has besides
LEAST = 0.8 / 4.2
BANDS = 48
# Short notices by which texts name their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software "
    "Foundation; either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
    "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE "
    "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (family, name, text): bodies and headers. Of a family, a place counts for those that hold most of their shingles there.
BODIES = [
    ("mit", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
     "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
     "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
     "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
     "OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
     "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
     "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
     "USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
     "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("mpl", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
     "one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "BSD-2-Clause", _BSD.format(third="")),
    ("bsd", "BSD-3-Clause", _BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
     "from this software without specific prior written permission. ")),
    *[("gnu", f"{name}-{version if '.' in version else version + '.0'}", _GNU.format(what=what, kind=kind, version=version))
      for name, kind, versions in (("GPL", "General", "2 3"), ("LGPL", "Lesser General", "2.1 3"), ("AGPL", "Affero General", "3"))
      for version in versions.split() for what in ("program", "library")],
]
#: (name, text): short notices, of which a text must hold every shingle: one other word is another license
NOTICES = [
    (name, f"{verb} under {the}{title}")
    for verb in ("licensed", "released", "distributed", "available", "published", "provided")
    for name, the, title in (
        ("MIT", "the ", "MIT License"), ("ISC", "the ", "ISC License"), ("Apache-2.0", "the ", "Apache License 2.0"), ("Apache-2.0", "the ", "Apache License Version 2.0"),
        ("Apache-2.0", "the ", "Apache 2.0 License"), ("BSD-2-Clause", "the ", "BSD 2-Clause License"), ("BSD-3-Clause", "the ", "BSD 3-Clause License"),
        *[(f"{n}-{v}.0", "the ", f"{t}{w} {v}") for n, t in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"),
          ("AGPL", "GNU Affero General Public License")) for v in ("2", "3") for w in (" version", " v") if (n, v) not in (("AGPL", "2"), ("LGPL", "2"))],
        ("MPL-2.0", "the ", "Mozilla Public License 2.0"), ("MPL-2.0", "the ", "Mozilla Public License version 2.0"),
        *[(f"CC-{k}-4.0", the, f"CC {k} 4.0") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for the in ("", "a ", "the ")],
        *[(f"CC-{k}-4.0", the, f"Creative Commons {t} 4.0") for k, t in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
          ("BY-ND", "Attribution-NoDerivatives")) for the in ("", "a ", "the ")],
    )
]
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])"


def _words(text: Column) -> Column:
    return _split(ascii_lower(F.coalesce(text, F.lit(""))))


def _split(low: Column) -> Column:
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def marks(templates: list[tuple[list[str], int]]) -> list[str]:
    """Words, given (words, least percentage) of each template, such that every text that holds the percentage of a template's shingles holds
    one of them: the shingles without any are too few. Long words go first, as they are rarer in other texts."""
    open_, out = [], []
    for words, least in templates:
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        # (shingles without a chosen word, how many may be without one)
        open_.append((shingles, -(-least * len(shingles) // 100) - 1))
    while open_:
        some = {w for shingles, _ in open_ for s in shingles for w in s}
        some = {w for w in some if len(w) > 6} or some

        def worth(word: str) -> tuple:
            left = [(sum(not any(word in w for w in s) for s in shingles), spare) for shingles, spare in open_]
            return sum(n <= spare for n, spare in left), -sum(n for n, _ in left), len(word), word

        best = max(some, key=worth)
        out.append(best)
        open_ = [({s for s in shingles if not any(best in w for w in s)}, spare) for shingles, spare in open_]
        open_ = [(shingles, spare) for shingles, spare in open_ if len(shingles) > spare]
    return out


def _shingles(words: Column) -> Column:
    """Hashes of all runs of ``SHINGLE`` words, in order. ``words`` has to be a column of its own."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))
    return F.when(n >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))


def _places(shingles: Column, own: list[int]) -> Column:
    """Where shingles of ``own`` stand."""
    return F.filter(F.transform(shingles, lambda h, i: F.when(h.isin(own), i)), lambda p: p.isNotNull())


def _signature(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band))))


def _templates(spark: SparkSession, templates: dict[str, str] | None) -> tuple[DataFrame, list[str], list[tuple[int, int, list[int]]]]:
    """(id, name, family, least, own, size, klass) of each template, words of which a match holds one, and (class, longest template, hashes). Without ``templates`` all that
    are known here; a text of ``TEMPLATES`` or of the caller is a family of its own."""
    given = [(f"{name}/own", name, PERCENT, text) for name, text in sorted((TEMPLATES if templates is None else templates).items())]
    if templates is None:
        given += [(family, name, PERCENT, text) for family, name, text in BODIES] + [(f"{text}/notice", name, 100, text) for name, text in NOTICES]
    rows = [(i, *row) for i, row in enumerate(given)]
    words = spark.createDataFrame(rows, "id int, family string, name string, least int, t string").withColumn("_words", _words(F.col("t")))
    found = words.select("id", "family", "name", "least", F.array_distinct(_shingles(F.col("_words"))).alias("own"), "_words").collect()
    if short := [r.name for r in found if not r.own]:
        raise ValueError(f"templates without a shingle: {short}")
    data = [(*r[:4], list(r.own), len(r.own), 1 << math.ceil(math.log2(len(r.own)))) for r in found]
    classes = [(k, [d for d in data if d[6] == k]) for k in sorted({d[6] for d in data})]
    table = spark.createDataFrame(data, "id int, family string, name string, least int, own array<bigint>, size int, klass int")
    return table, marks([(r["_words"], r.least) for r in found]), [(k, max(d[5] for d in some), sorted({h for d in some for h in d[4]})) for k, some in classes]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, place): each match of a document, ``place`` being its first shingle's word, from 0."""
    known, needed, classes = _templates(docs.sparkSession, templates)
    all_hashes = F.array(*[F.lit(h) for h in sorted({h for _, _, own in classes for h in own})])
    tags = _spdx(docs, key, text) if templates is None else None
    low = ascii_lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    # the row number keeps each filter above what it reads: pushed below, it would be worked out again for every use
    rows = docs.select(F.col(f"`{key}`").alias(key), low.alias("_low"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.where(reduce(or_, [F.contains(F.col("_low"), F.lit(w)) for w in needed], F.lit(False)) & (F.col("_at") >= 0))
    rows = rows.select(key, "_at", _split(F.col("_low")).alias("_words"))
    rows = rows.select(key, _shingles(F.col("_words")).alias("_all"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.where(F.arrays_overlap("_all", all_hashes) & (F.col("_at") >= 0))
    # one look-up in a set of constants a shingle and class; what the generator gives is not worked out again
    kinds = F.array(*[F.struct(F.lit(k).alias("klass"), F.lit(most).alias("most"), _places(F.col("_all"), own).alias("places")) for k, most, own in classes])
    rows = rows.select(key, "_at", "_all", F.explode(kinds).alias("k")).where(F.size("k.places") > 0).select(
        key, "_at", "_all", F.col("k.places").alias("_places"), F.col("k.klass").alias("klass"), F.col("k.most").alias("most")
    )
    # a window of 2 * klass shingles begins at every multiple of klass
    numbers = F.array_distinct(F.flatten(F.transform("_places", lambda p: F.array(F.floor(p / F.col("klass")), F.floor(p / F.col("klass")) - 1))))
    windows = rows.select(key, "_at", "_all", "klass", "most", F.explode(numbers).alias("number")).where("number >= 0")
    begin = (F.col("number") * F.col("klass")).cast("int")
    low = F.greatest(F.lit(0), begin - 2 * F.col("most"))
    windows = windows.select(
        key, "_at", "number", "klass", low.alias("low"), F.slice("_all", begin + 1, 2 * F.col("klass")).alias("_window"),
        F.slice("_all", low + 1, 2 * F.col("klass") + 4 * F.col("most")).alias("_near"),
    )
    bands = windows.select(key, "_at", "number", "klass", "low", "_near", F.posexplode(_signature(F.col("_window"))).alias("band", "value"))
    wanted = F.broadcast(known.select("id", "family", "name", "least", "own", "size", "klass", F.posexplode(_signature(F.col("own"))).alias("band", "value")))
    met = bands.join(wanted, ["klass", "band", "value"]).groupBy("_at", "number", "klass", "id").agg(
        *[F.first(c).alias(c) for c in (key, "low", "_near", "family", "name", "least", "own", "size")]
    )
    # the stretches that begin at a template's shingle and hold enough of the template
    hits = F.filter(
        F.transform("_near", lambda h, i: F.when(F.array_contains("own", h), F.struct(
            (F.col("low") + i).cast("long").alias("place"),
            F.size(F.array_intersect(F.slice("_near", i + 1, 2 * F.col("size")), "own")).alias("held"),
            # a family is ranked by little more than a text's own length (its repeated shingles count once): it reaches less far into a neighbour
            F.size(F.array_intersect(F.slice("_near", i + 1, (F.col("size") * 9 / 8).cast("int")), "own")).alias("near")))),
        lambda x: x.isNotNull() & (100 * x.held >= F.col("least") * F.col("size")),
    )
    found = met.withColumn("_hits", hits).where(F.size("_hits") > 0).select(key, "_at", "family", "name", F.explode("_hits").alias("hit"))
    best = F.max("hit.near").over(Window.partitionBy("_at", "family", "hit.place"))
    found = found.withColumn("_best", best).where("hit.near = _best").groupBy("_at", "name").agg(F.first(key).alias(key), F.min("hit.place").alias("place"))
    found = found.select(key, F.col("name").alias("license"), "place")
    return found if tags is None else found.unionByName(tags)


def _spdx(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The identifiers of SPDX lines, as they are written; ``place`` is the word at which the first such line begins."""
    t = F.col("_t")
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_t")).where(F.coalesce(t.rlike(SPDX), F.lit(False)))
    place = F.size(_words(F.substring(t, F.lit(1), F.regexp_instr(t, F.lit(SPDX)) - 1))).cast("long")
    lines = rows.select(key, place.alias("place"), F.explode(F.regexp_extract_all(t, F.lit(SPDX), F.lit(1))).alias("line"))
    names = F.split(F.regexp_replace(F.regexp_replace("line", r"(?i)\bWITH\s+\S+", " "), r"[()]", " "), r"\s+", -1)
    # an expression ends at the first word that no operator joins to it
    kept = F.regexp_extract(F.array_join(F.filter(names, lambda w: w != ""), " "), r"(?i)^(\S+(?: (?:AND|OR) \S+)*)", 1)
    return lines.select(key, F.explode(F.split(kept, r"(?i) (?:AND|OR) ", -1)).alias("license"), "place").where("license <> ''").distinct()


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_licenses, licenses) of each document: names in order, comma-joined."""
    found = license_matches(docs, templates, key, text).groupBy(key).agg(F.array_sort(F.collect_set("license")).alias("names"))
    return docs.select(F.col(f"`{key}`").alias(key)).join(found, key, "left").select(
        key, F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses")
    )
