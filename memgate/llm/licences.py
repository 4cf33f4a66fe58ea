"""License scans, in DataFrame functions only: units of a text against licence templates by the Dice coefficient of their word bigrams.

Units of a text are its lines and its paragraphs of several lines (wrapped notices), normalised to lower case and words
of letters and digits; and runs of sentences inside a paragraph, cut at line ends and after . ! ? : and ;. A template with b bigrams can only reach the threshold
t with units of b * t / (2 - t) to b * (2 - t) / t bigrams; these size bounds pick the candidate templates before any
bigram is compared. The words of a unit are not bounded, as repeated bigrams count once.

Defined cases: a null or empty text has no licence; a unit that reaches several templates takes the best, ties the first
by name; repeated units count again; a table without rows gives none. Of runs that overlap, the best counts, the shorter
and then the first of equal ones; none counts that overlaps a line or paragraph found as a whole.
"""

from __future__ import annotations


import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgate.llm._shared import materialize
from memgate.llm.quality_rules import let

#: Notices by licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Standard paragraphs and headers in full. The SQL of op10 knows only TEMPLATES.
FULL = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def bigrams(words: Column) -> Column:
    return let(words, lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x)))))


def template_bigrams(text: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def anchors(shapes, threshold: float) -> list[str]:
    """Words of which every unit that reaches a template has one.

    Such a unit shares t / (2 - t) of the template's bigrams; words are taken, long ones first, until fewer have none of them."""
    words: set[str] = set()
    for _, own in shapes:
        open_ = [g.split(" ") for g in own]
        for w in sorted({w for g in open_ for w in g}, key=lambda w: (-len(w), w)):
            if len(open_) < len(own) * threshold / (2 - threshold):
                break
            words.add(w)
            open_ = [g for g in open_ if w not in g]
    return sorted(words)


def once(value: Column) -> Column:
    """A generated column of one value: filters on it are not moved before it, where they would work it out anew for each mention."""
    return F.explode(F.array(value))


class Anchor:
    """Tests for texts that have one of some words: plain substrings, which let through all that the pattern does, and then the pattern."""

    def __init__(self, words: list[str]):
        self.parts = [w for w in words if not any(v != w and v in w for v in words)]
        self.pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z0-9])"

    def maybe(self, text: Column) -> Column:
        return let(F.lower(text), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in self.parts], F.lit(False)))

    def holds(self, text: Column) -> Column:
        return self.maybe(text) & F.rlike(text, F.lit(self.pattern))


def units(docs: DataFrame, least: float, most: float, anchor: Anchor) -> DataFrame:
    """doc_id and bigrams of the lines and paragraphs of several lines whose size can fit some template."""
    paragraphs = F.filter(F.split("text", r"\n[\x20\x09\r]*\n"), lambda s: F.contains(F.trim(s), F.lit("\n")))
    # n distinct bigrams take more than n words, so more than 2n characters
    own = F.filter(F.transform(F.concat(F.split("text", "\n"), paragraphs), lambda s, i: F.struct((i + 1).alias("unit"), s.alias("s"))), lambda x: (F.length(x["s"]) > 2 * least) & anchor.holds(x["s"]))
    rows = docs.select("doc_id", F.explode(own).alias("x")).select("doc_id", "x.unit", once(words_of(F.col("x.s"))).alias("words"))
    rows = rows.filter(F.size("words") > least).select("doc_id", "unit", once(bigrams(F.col("words"))).alias("grams"))
    return rows.filter((F.size("grams") >= least) & (F.size("grams") <= most))


def scored(rows: DataFrame, shapes, threshold: float) -> DataFrame:
    """rows (with bigrams `grams`) that reach a template: its licence, and dice."""
    n = F.size("grams")
    scores = []
    for name, own in shapes:
        lo, hi = size_bounds(len(own), threshold)
        both = F.size(F.array_intersect("grams", F.array(*(F.lit(g) for g in own))))
        dice = F.when((n >= lo) & (n <= hi), 2.0 * both / (n + len(own))).otherwise(F.lit(0.0))
        scores.append(F.struct((-dice).alias("d"), F.lit(name).alias("licence")))
    best = rows.select("*", once(F.array_min(F.array(*scores))).alias("b")).filter(F.col("b.d") <= -threshold)
    return best.withColumns({"licence": F.col("b.licence"), "dice": -F.col("b.d")}).drop("b", "grams")


def runs(docs: DataFrame, shapes, threshold: float, most: float, every: Column, anchor: Anchor) -> DataFrame:
    """doc_id, unit (from 1 in each row), licence and dice of runs of sentences inside a paragraph.

    No run is left out that could be best: without the first sentence a run is as good if no template bigram starts there,
    and without the last one if no template bigram comes there for the first time."""
    parts = F.filter(F.split("text", r"\n[\x20\x09\r]*\n"), lambda s: anchor.holds(s))
    rows = docs.select("doc_id", F.posexplode(parts).alias("unit", "s")).select("doc_id", (F.col("unit") + 1).alias("unit"), "s", F.monotonically_increasing_id().alias("part"))
    sentences = lambda s: F.flatten(F.transform(F.split(s, "\n"), lambda line, k: F.transform(F.split(line, r"(?<=[.!?:;])[\x20\x09\r]+"), lambda x: F.struct(k.alias("line"), words_of(x).alias("w")))))
    rows = rows.select("doc_id", "unit", "part", F.filter(sentences(F.col("s")), lambda x: F.size(x["w"]) > 0).alias("own")).filter(F.size("own") > 1)
    rows = rows.select("doc_id", "unit", "part", "own", let(F.flatten(F.transform("own", lambda x: x["w"])), lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))).alias("g"))
    enough = [F.size(F.array_intersect("g", F.array(*(F.lit(x) for x in own)))) >= len(own) * threshold / (2 - threshold) - 1e-9 for _, own in shapes]
    rows = rows.filter(F.arrays_overlap("g", every)).filter(F.greatest(*(e.cast("int") for e in enough)) == 1)
    none = F.array().cast("array<struct<line:int,s:int,e:int>>")
    spans = F.aggregate("own", none, lambda a, x: let(F.coalesce(F.get(a, F.size(a) - 1)["e"], F.lit(0)), lambda s: F.concat(a, F.array(F.struct(x["line"].cast("int").alias("line"), s.alias("s"), (s + F.size(x["w"])).alias("e"))))))
    rows = rows.select("doc_id", "unit", "part", "g", spans.alias("spans"))
    at = rows.select("*", F.explode("spans").alias("x")).select("doc_id", "unit", "part", "g", "spans", F.col("x.line").alias("line"), F.col("x.s").alias("s"), F.col("x.e").alias("first_end"))
    size = F.size("g")
    stream = F.slice("g", F.col("s") + 1, F.greatest(size - F.col("s"), F.lit(0)))
    at = at.withColumn("rest", stream)
    # up to where there are more distinct bigrams than any template allows
    end = let(F.array_distinct("rest"), lambda d: F.when(F.size(d) > int(most), F.array_position("rest", F.get(d, F.lit(int(most)))) - 1).otherwise(F.size("rest")))
    fresh = F.when(F.arrays_overlap(F.slice("rest", 1, F.greatest(F.col("first_end") - F.col("s"), F.lit(0))), every), F.array_intersect(F.slice("rest", F.lit(1), end.cast("int")), every)).otherwise(F.array().cast("array<string>"))
    ends = F.transform(fresh, lambda x: let(F.col("s") + F.array_position("rest", x).cast("int") + 1, lambda p: F.get(F.filter("spans", lambda y: y["e"] >= p), F.lit(0))["e"]))
    same = F.filter("spans", lambda y: y["line"] == F.col("line"))
    whole = F.filter(F.array(F.when(F.get(same, F.lit(0))["s"] == F.col("s"), F.get(same, F.size(same) - 1)["e"]), F.when(F.col("s") == 0, size + 1)), lambda y: y.isNotNull())
    at = at.withColumns({"ends": ends, "whole": whole})
    found = at.select("doc_id", "unit", "part", "g", "s", "whole", F.explode(F.array_distinct(F.concat("ends", "whole"))).alias("e"))
    found = found.select("doc_id", "unit", "part", "s", "e", F.array_contains("whole", F.col("e")).alias("own"), F.array_distinct(F.slice("g", F.col("s") + 1, F.greatest(F.col("e") - F.col("s") - 1, F.lit(0)))).alias("grams"))
    found = scored(found.filter(F.arrays_overlap("grams", every)), shapes, threshold)
    order = F.struct((~F.col("own")).alias("inner"), (-F.col("dice")).alias("d"), (F.col("e") - F.col("s")).alias("n"), "s", "e", "licence")
    found = found.groupBy("doc_id", "unit", "part").agg(F.array_sort(F.collect_list(order)).alias("all"))
    taken = F.aggregate("all", F.slice("all", 1, 0), lambda a, x: F.when(x["inner"] & F.exists(a, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), a).otherwise(F.concat(a, F.array(x))))
    return found.select("doc_id", "unit", F.explode(F.filter(taken, lambda x: x["inner"])).alias("x")).select("doc_id", "unit", "x.licence", (-F.col("x.d")).alias("dice"))


def scan_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + FULL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, licence and dice of every unit that reaches a template; units of runs are numbers of paragraphs, negative."""
    shapes = [(name, template_bigrams(text)) for name, text in templates]
    bounds = [size_bounds(len(g), threshold) for _, g in shapes]
    least, most, words = min(b[0] for b in bounds), max(b[1] for b in bounds), anchors(shapes, threshold)
    anchor = Anchor(words)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = materialize(own.filter(anchor.maybe(F.col("text"))))  # read twice; of most corpora a small part
    # a unit must share a bigram with some template at all
    every = F.array(*(F.lit(g) for g in sorted({g for _, own in shapes for g in own})))
    whole = scored(units(own, least, most, anchor).filter(F.arrays_overlap("grams", every)), shapes, threshold).select("doc_id", "unit", "licence", "dice")
    inner = runs(own, shapes, threshold, most, every, anchor)
    return whole.union(inner.withColumn("unit", -F.col("unit")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + FULL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, n_units, best dice: one row for each licence of a document that has any."""
    found = scan_units(docs, id_col, text_col, templates, threshold)
    return found.groupBy("doc_id", "licence").agg(F.count("*").alias("n_units"), F.round(F.max("dice"), 6).alias("dice"))
