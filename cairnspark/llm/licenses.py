"""License scans in DataFrame functions only: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by length. For a group of templates of at most ``s`` words with room for edits, a text is cut into windows
of 2 s words, one every s words, so that any stretch of up to s words lies whole in a window. A window and a template that match
share at least a known part of their shingles; with BANDS bands of one value each the chance that no band agrees is below
MISS for every template (``miss`` computes it, and a test holds it). What the bands retrieve is confirmed by exact containment.

Only windows with an anchor word are hashed: the anchors are chosen so that no text without one can hold 80 % of any template's
shingles, so this drops no match.

Defined results: null or empty texts hold no licenses; repeated rows are counted each; a text that states a license twice in
separate windows has two windows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
PERCENT = 80
BANDS = 64
MISS = 0.0005
#: Longest template of a group, with room for edits, in words.
GROUPS = (6, 12, 24, 48, 96, 192, 384)

#: Names and wordings of licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "mit-line": "Released under the MIT License",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = r"[a-z0-9]+"


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def shingles(tokens: list[str]) -> list[str]:
    return sorted({" ".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))})


def group_of(tokens: list[str]) -> int:
    """The group whose windows hold a template even with a quarter of its words added."""
    return next(s for s in GROUPS if s >= len(tokens) and (s >= 1.25 * len(tokens) or s == GROUPS[0]))


def miss(template: str) -> float:
    """The chance that no band of a matching window agrees with the template's."""
    tokens = words(template)
    n, held = len(shingles(tokens)), 2 * group_of(tokens) - SHINGLE + 1
    common = -(-PERCENT * n // 100)
    return (1 - common / max(held + n - common, n)) ** BANDS


def anchor_words(templates: dict[str, str]) -> list[str]:
    """Words such that fewer than PERCENT of every template's shingles lack all of them."""
    counts = Counter(w for t in templates.values() for w in set(words(t)) if len(w) > 5)
    chosen: list[str] = []
    for text in templates.values():
        own = shingles(words(text))
        while 100 * sum(not set(s.split()) & set(chosen) for s in own) >= PERCENT * len(own):
            lacking = [s.split() for s in own if not set(s.split()) & set(chosen)]
            best = Counter(w for s in lacking for w in set(s))
            # a long word, in many templates: common words would let every text pass
            chosen.append(max((w for w in best if w not in chosen), key=lambda w: (len(w) > 5, counts[w] + best[w] / 1000, len(w), w)))
    return sorted(chosen)


def _shingled(tokens: Column) -> Column:
    last = F.greatest(F.lit(1), F.size(tokens) - SHINGLE + 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, SHINGLE), " ")))


def _band_values(hashes: Column) -> Column:
    """One MinHash value for each band: the least of the shingles' hashes by the band's own seed."""

    def seeded(band: int):
        return lambda shingle: F.xxhash64(F.lit(band), shingle)

    return F.array(*[F.xxhash64(F.lit(b), F.array_min(F.transform(hashes, seeded(b)))) for b in range(BANDS)])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found: id_col, license, windows (how many hold it), containment (the best), word (number of the first word of the first such window)."""
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    # a fixed list of wordings, some hundred rows of band values: the broadcast side does not grow with the documents
    rows = [(name, group_of(words(text)), shingles(words(text))) for name, text in templates.items()]
    known = spark.createDataFrame(rows, "license string, grp int, template array<string>")
    known = known.select("license", "grp", "template", F.explode(_band_values(F.col("template"))).alias("band"))
    anchors = "|".join(anchor_words(templates))
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rowed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text.alias("_t")).filter(F.col("_t").rlike(rf"(?:^|[^a-z0-9])(?:{anchors})(?:[^a-z0-9]|$)"))
    tokens = rowed.select("_row", "_id", F.regexp_extract_all("_t", F.lit(f"({_WORD})"), F.lit(1)).alias("_w"))
    marked = tokens.withColumn("_a", F.filter(F.transform("_w", lambda w, i: F.when(w.rlike(rf"^(?:{anchors})$"), i)), lambda x: x.isNotNull()))
    # the windows of a group are numbered; an anchor at word i lies in windows i div s and the one before
    numbers = lambda s: F.array_distinct(F.flatten(F.transform("_a", lambda i: F.array((i / s).cast("int"), F.greatest(F.lit(0), (i / s).cast("int") - 1)))))
    groups = sorted({r[1] for r in rows})
    windows = marked.select("_row", "_id", "_w", F.explode(F.array(*[F.struct(F.lit(s).alias("grp"), numbers(s).alias("at")) for s in groups])).alias("_g"))
    windows = windows.select("_row", "_id", "_w", F.col("_g.grp").alias("grp"), F.explode("_g.at").alias("at"))
    windows = windows.select("_row", "_id", "grp", "at", _shingled(F.slice("_w", F.col("at") * F.col("grp") + 1, 2 * F.col("grp"))).alias("own"))
    banded = windows.select("*", F.explode(F.array_distinct(_band_values(F.col("own")))).alias("band"))
    met = banded.join(F.broadcast(known), ["grp", "band"]).dropDuplicates(["_row", "grp", "at", "license"])
    share = F.size(F.array_intersect("own", "template")) / F.size("template")
    held = met.withColumn("share", share).filter(100 * F.size(F.array_intersect("own", "template")) >= PERCENT * F.size("template"))
    found = held.groupBy("_row", "license").agg(F.first("_id").alias(id_col), F.count("*").alias("windows"), F.max("share").alias("containment"), F.min(F.col("at") * F.col("grp")).cast("long").alias("word"))
    return found.select(id_col, "license", "windows", "containment", "word")
