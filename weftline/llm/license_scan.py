"""Licence scan in DataFrame operations only: TF-IDF cosine to templates, then inheritance.

What is compared is every run of one to four neighbouring lines of a file, every block of
lines between blank ones, and the whole text of licence files. Weights come from the
templates alone, so the verdict of a text doesn't depend on other texts, and which runs can
reach the threshold at all is known from a few words: the others are never cut into terms.
A file without a licence of its own inherits that of the nearest directory above it that has
a licence file.
"""

from __future__ import annotations

from collections import Counter
from math import log, sqrt

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, materialize

# Titles, notices, identifiers and texts of public licences, as their stewards word them.
_WARRANTY_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_CONDITIONS_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE_BSD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GRANT_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_REST_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", _GRANT_MIT),
    ("MIT", f"MIT License Copyright (c) {_GRANT_MIT} {_REST_MIT}"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_CONDITIONS_BSD} {_ENDORSE_BSD} {_WARRANTY_BSD}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_CONDITIONS_BSD} {_WARRANTY_BSD}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
# English words that say nothing about a licence; they are no terms.
STOP = "a all an and any are as at be but by can do each for from had has have he her his how if in into is it its may more no nor not of on only or other our out shall she so some such than that the their them then there these they this those to under until up upon was way we were what when where which while who whom whose will with within without would you your".split()
#: Names of licence files, before a dot or the end.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[^/]*)?$"
#: A term: letters and digits, with further numbers after points, as in 4.0.
TERM = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"
#: What stands between two blocks: lines without a letter or digit.
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: Neighbouring lines that are compared together, at most, besides the whole block.
LINES = 4


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is worked out once for each row, not again wherever a projection names it."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _any_of(words: list[str]) -> str:
    """A pattern for any of these words as a tree of their letters, so that few alternatives are tried at a place."""
    below: dict[str, list[str]] = {}
    for w in words:
        if w:
            below.setdefault(w[0], []).append(w[1:])
    parts = [regex.escape(c) + _any_of(rest) for c, rest in sorted(below.items())]
    if not parts:
        return ""
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in words else "")


class Weights:
    """What follows from the templates: the weight of each term in each, and what a unit needs to be near one.

    A term weighs (1 + ln tf) * (1 + ln((1 + N) / (1 + df))), df counted over the N templates;
    a term of none of them has a df of 0.
    """

    def __init__(self, templates: list[tuple[str, str]], least: float):
        counts = [Counter(t for t in regex.findall(TERM, text.lower()) if t not in STOP) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        self.idf = {t: 1 + log((1 + len(counts)) / (1 + n)) for t, n in df.items()}
        self.rare = 1 + log(1 + len(counts))
        self.vectors, self.needed, signs = [], [], set()
        bound = (least - 1e-6) ** 2
        for c in sorted(counts, key=len):
            w = {t: (1 + log(n)) * self.idf[t] for t, n in c.items()}
            norm = sqrt(sum(x * x for x in w.values()))
            w = {t: x / norm for t, x in w.items()}
            # A unit's cosine is at most the length of the part of the template that it shares:
            # so it has one of the terms that are left when others, too short together, are
            # taken away (signs of other templates last), and at least so many terms in all.
            gone, left = 0.0, set(w)
            for t in sorted(w, key=lambda t: (t in signs, -df[t], t)):
                if gone + w[t] ** 2 >= bound:
                    break
                gone += w[t] ** 2
                left.discard(t)
            signs |= left
            total, n = 0.0, 0
            for x in sorted(w.values(), reverse=True):
                if total >= bound:
                    break
                total, n = total + x * x, n + 1
            self.needed.append((sorted(w), n))
        for c in counts:
            w = {t: (1 + log(n)) * self.idf[t] for t, n in c.items()}
            norm = sqrt(sum(x * x for x in w.values()))
            self.vectors.append({t: x / norm for t, x in w.items()})
        #: A unit without one of these is below `least` for every template.
        self.signs = r"(?iu)(?<![\p{L}\p{N}])" + _any_of(sorted(signs)) + r"(?![\p{L}\p{N}])"
        # Nor is its cosine more than the share that terms of templates have in its own length: of
        # o occurrences of k such terms at most k * (1 + ln(o / k))^2 * top^2, and rare^2 for each other.
        self.room = (max(self.idf.values()) / self.rare) ** 2 * (1 / bound - 1)

    def _reaches(self, unknown: Column, k: Column, o: Column) -> Column:
        return (k > 0) & (unknown <= k * F.pow(1 + F.log(o / F.greatest(k, F.lit(1))), F.lit(2.0)) * self.room + 1e-6)

    def possible(self, units: DataFrame) -> DataFrame:
        """Those of units(.., unit) that can reach `least`."""
        terms = _once(units, "_t", _terms(F.col("unit")))
        terms = _once(terms, "_known", F.array_intersect("_t", F.lit(sorted(self.idf))))
        k, o = F.size("_known"), F.size(F.filter("_t", lambda x: F.array_contains(F.col("_known"), x)))
        terms = _once(terms.where(k > 0), "_s", F.struct((F.size(F.array_except("_t", F.lit(STOP))) - k).alias("u"), k.alias("k"), o.alias("o")))
        terms = terms.where(self._reaches(F.col("_s.u"), F.col("_s.k"), F.col("_s.o")))
        enough = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).alias("n")) for t, n in self.needed])
        return terms.where(F.exists(enough, lambda x: F.size(F.array_intersect(F.col("_known"), x["t"])) >= x["n"])).select(*units.columns)

    def runs(self, blocks: DataFrame) -> DataFrame:
        """(a, b, unit): runs of 1 to LINES neighbouring lines of blocks(a, b, block), and whole blocks, that can reach `least`.

        What a run has is told by its lines: it has as many terms of templates as these
        together at most, and as many others as one of them at least.
        """
        df = _once(blocks.select("a", "b", F.split("block", "\n").alias("_l")), "_t", F.transform("_l", _terms))
        df = _once(df, "_k", F.transform("_t", lambda t: F.array_intersect(t, F.lit(sorted(self.idf)))))
        each = F.zip_with("_t", "_k", lambda t, k: F.struct((F.size(F.array_except(t, F.lit(STOP))) - F.size(k)).alias("u"), F.size(k).alias("k"), F.size(F.filter(t, lambda x: F.array_contains(k, x))).alias("o")))
        df = _once(df, "_s", each)
        n = F.size("_s")

        def starts(length: int) -> Column:
            some = F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(some, lambda i: F.struct(i.alias("i"), F.lit(length).alias("n")))

        spans = F.concat(*[starts(k) for k in range(1, LINES + 1)], F.array(F.struct(F.lit(1).alias("i"), n.alias("n"))))
        df = df.select("a", "b", "_l", "_s", F.explode(F.array_distinct(spans)).alias("_r"))
        part = F.slice("_s", F.col("_r.i"), F.col("_r.n"))
        total = lambda name: F.aggregate(part, F.lit(0), lambda x, y: x + y[name])
        most = F.struct(F.array_max(F.transform(part, lambda x: x["u"])).alias("u"), F.least(total("k"), F.lit(len(self.idf))).alias("k"), total("o").alias("o"))
        df = _once(df, "_m", most).where(self._reaches(F.col("_m.u"), F.col("_m.k"), F.greatest("_m.o", "_m.k")))
        return self.possible(df.select("a", "b", F.array_join(F.slice("_l", F.col("_r.i"), F.col("_r.n")), "\n").alias("unit")))


def unit_verdicts(units: DataFrame, templates: list[tuple[str, str]], weights: Weights, least: float) -> DataFrame:
    """(u, best: score and licence) for each of units(u, unit) whose best cosine is at least `least`."""
    spark = units.sparkSession
    tf = units.select("u", F.explode(_terms(F.col("unit"))).alias("term")).where(~F.col("term").isin(STOP)).groupBy("u", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = [(t, x, {i: v[t] for i, v in enumerate(weights.vectors) if t in v}) for t, x in sorted(weights.idf.items())]
    wanted = spark.createDataFrame(rows, "wt string, idf double, ws map<int,double>")  # as many rows as the templates have words
    weighed = tf.join(F.broadcast(wanted), F.col("term") == F.col("wt"), "left").select("u", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(weights.rare))).alias("w"), "ws")
    dots = [F.sum(F.col("w") * F.coalesce(F.element_at("ws", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(len(templates))]
    sums = weighed.groupBy("u").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"), *dots)
    # Rounded, so that the order in which tasks add makes no ties or orders of its own.
    each = [F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(name).alias("licence")) for i, (name, _) in enumerate(templates)]
    best = F.greatest(*each, F.struct(F.lit(0.0).alias("score"), F.lit("").alias("licence")))
    return sums.select("u", best.alias("best")).where(F.col("best.score") >= least).select("u", "best")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """files without their text, with licence, licence_score, licence_via and licence_from.

    licence_via is header (a run of lines or a block of the file), file (the whole text of a
    licence file) or inherited; licence_from is the path that the licence was found in. The
    highest cosine counts, of equal ones the last name in order; of licence files in one
    directory likewise. Without a licence the four columns, which replace others of these
    names, are null. Null and empty texts have no licence of their own; null paths inherit
    none and are no licence files. Texts of any length are compared as a whole. Repeated rows
    are told each; the verdict of a text is found once. An empty table gives an empty table;
    other columns are kept, whatever their names.
    """
    weights = Weights(templates, least)
    a, b, is_file, folder, va, vb, header, best_any, mine_, kd, given = fresh(files, "_a", "_b", "_is_file", "_folder", "_va", "_vb", "_header", "_any", "_mine", "_kd", "_given")
    made = ["licence", "licence_score", "licence_via", "licence_from"]
    own = [c for c in files.columns if c != text_col and c.lower() not in made]
    path, text = col(path_col), col(text_col)
    rows = files.select(*[col(c) for c in own], F.xxhash64(text).alias(a), F.xxhash64(F.lit(7), text).alias(b), F.coalesce(path.rlike(LICENCE_FILE), F.lit(False)).alias(is_file), _directory(path).alias(folder))
    texts = files.where(text.isNotNull()).select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), text.alias("text"), F.coalesce(path.rlike(LICENCE_FILE), F.lit(False)).alias("whole"))
    sign = F.lit(weights.signs)
    # Only texts and blocks with a sign are cut, into runs of lines, and only runs that can
    # have a licence are cut into terms.
    signed = texts.where(F.rlike("text", sign))
    blocks = signed.select("a", "b", F.explode(F.array_distinct(F.split("text", BETWEEN))).alias("block")).where(F.rlike("block", sign))
    whole = weights.possible(signed.where("whole").select("a", "b", F.col("text").alias("unit")))
    said = weights.runs(blocks).select("a", "b", F.lit("header").alias("via"), "unit").unionByName(whole.select("a", "b", F.lit("file").alias("via"), "unit"))
    said = materialize(said.select("a", "b", "via", F.concat(F.hex(F.xxhash64("unit")), F.hex(F.xxhash64(F.lit(7), "unit"))).alias("u"), "unit"))
    units = said.groupBy("u").agg(F.first("unit").alias("unit"))
    found = unit_verdicts(units, templates, weights, least).select(F.concat(F.lit("u:"), "u").alias("ku"), "best")
    verdict = said.select("a", "b", "via", "u").join(found, F.concat(F.lit("u:"), "u") == F.col("ku"))
    top = F.max(F.struct("best.score", "best.licence", "via"))
    verdict = verdict.groupBy("a", "b").agg(F.max(F.when(F.col("via") == "header", F.struct("best.score", "best.licence", "via"))).alias("header"), top.alias("any"))
    verdict = materialize(verdict.select(F.col("a").alias(va), F.col("b").alias(vb), F.col("header").alias(header), F.col("any").alias(best_any)))
    # Whether the whole text counts depends on the file's name, so both verdicts come along.
    mine = F.when(F.col(is_file), F.col(best_any)).otherwise(F.col(header))
    rows = materialize(rows.join(verdict, (F.col(a) == F.col(va)) & (F.col(b).bitwiseXOR(F.col(vb)) == 0), "left").select(*[col(c) for c in own], is_file, folder, mine.alias(mine_)))

    roots = rows.where(F.col(is_file) & F.col(mine_).isNotNull()).groupBy(F.col(folder).alias("root")).agg(F.max(F.struct(F.col(mine_)["score"].alias("score"), F.col(mine_)["licence"].alias("licence"), path.alias("path"))).alias("given"))
    need = rows.where(F.col(mine_).isNull() & F.col(folder).isNotNull()).select(F.col(folder).alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")), F.array(F.lit("")))
    climbed = need.select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = climbed.join(roots.select(F.concat(F.lit("/"), "root").alias("kr"), "given"), F.concat(F.lit("/"), "up") == F.col("kr"))
    nearest = nearest.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "given")).alias("best")).select(F.concat(F.lit("/"), "dir").alias(kd), F.col("best.given").alias(given))
    joined = rows.join(nearest, F.when(F.col(mine_).isNull(), F.concat(F.lit("/"), F.col(folder))) == F.col(kd), "left")
    has = F.col(mine_).isNotNull()
    return joined.select(
        *[col(c) for c in own],
        F.coalesce(F.col(mine_)["licence"], F.col(given)["licence"]).alias("licence"),
        F.coalesce(F.col(mine_)["score"], F.col(given)["score"]).alias("licence_score"),
        F.when(has, F.col(mine_)["via"]).when(F.col(given).isNotNull(), F.lit("inherited")).alias("licence_via"),
        F.when(has, path).otherwise(F.col(given)["path"]).alias("licence_from"),
    )
