"""Licence scans (2): Dice coefficient over word bigrams between normalised text and licence templates.

Texts are looked at whole, by paragraph and by line, since a licence may be the
text, a part of it or one line. Two bounds keep most of that from being
compared. A part that is similar enough to a template holds at least one of the
template's anchor words, chosen so that the bigrams without any of them are too
few to reach the threshold; texts and parts without an anchor are left out. And
with ``a`` and ``b`` bigrams the coefficient is at most ``2 min(a, b) / (a + b)``,
which rules templates of other sizes out.

Columns only; everything about a text stays in its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, unnest

# The wording of well-known licences and notices, shortened where a text goes on for pages.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means.""",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
THRESHOLD = 80
#: Words of everyday text, which make poor anchors.
EVERYDAY = frozenset({"a", "all", "and", "any", "by", "for", "in", "is", "may", "not", "of", "on", "or", "that", "the", "this", "to", "under",
                      "with", "work", "you"})


def words(text: str) -> list[str]:
    """The normalised words of a template: letters and digits in lower case."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(found: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(found, found[1:])}


def anchors(template: str, percent: int) -> set[str]:
    """Words of which any part with a coefficient of ``percent`` holds one; rare and long words are tried first."""
    left = bigrams(words(template))
    needed = -(-percent * len(left) // (200 - percent))  # bigrams that must be shared at least
    chosen: set[str] = set()
    for word in sorted(set(words(template)), key=lambda w: (w in EVERYDAY, -len(w), w)):
        if len(left) < needed:
            break
        fewer = {b for b in left if word not in b.split()}
        if len(fewer) < len(left):
            chosen.add(word)
            left = fewer
    return chosen


def _bigrams(text: Column) -> Column:
    """The different bigrams of a normalised text, whose words are parted by single blanks."""
    # Inside the lambda the words are a value; written out, each bigram would split the text again.
    return let(F.split(text, " "), lambda w: F.array_distinct(F.transform(
        F.slice(w, 2, F.size(w)), lambda second, i: F.concat_ws(" ", F.get(w, i), second))))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def licences(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
             percent: int = THRESHOLD) -> DataFrame:
    """A row for every part of a text that is like a template: id, ``scope``, ``part``, ``licence``, ``dice``.

    ``scope`` is ``line``, ``paragraph`` (lines without a blank one between) or
    ``text``; ``part`` its number from 0. A paragraph of one line and a text of
    one paragraph are not listed again. A part has the template with the largest
    coefficient, of equal ones the first by name, if it has at least ``percent``
    hundredths. Different bigrams count once; a part without two words has none
    and is like nothing. Null and empty texts give no row; each copy of a row
    gives its own.
    """
    sizes = {name: len(bigrams(words(t))) for name, t in templates.items()}
    some = sorted({a for t in templates.values() for a in anchors(t, percent)})
    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, some)) + r")(?![\p{L}\p{N}])"
    least = min(-(-percent * n // (200 - percent)) for n in sizes.values())
    here = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.lower("text").rlike(pattern))
    part = lambda scope, pieces: F.transform(pieces, lambda p, i: F.struct(F.lit(scope).alias("scope"), i.alias("part"), p.alias("p")))
    lines, paragraphs = F.split("text", "\n", -1), F.split("text", r"\n[\x20\t\r]*\n", -1)
    several = F.filter(part("paragraph", paragraphs), lambda x: x["p"].contains("\n"))
    whole = F.when(F.size(paragraphs) > 1, part("text", F.array("text"))).otherwise(F.array().cast("array<struct<scope:string,part:int,p:string>>"))
    parts = unnest(here, ["id"], F.concat(part("line", lines), several, whole), "at", "x").select("id", "x.scope", "x.part", _normal(F.col("x.p")).alias("p")).where(F.col("p").rlike(pattern))
    # As many words are needed as make the bigrams that are needed.
    sets = parts.where(F.size(F.split("p", " ")) > least).select("id", "scope", "part", _bigrams(F.col("p")).alias("b"))
    known = F.array(*[F.struct(F.lit(n).alias("licence"), F.array(*[F.lit(b) for b in sorted(bigrams(words(t)))]).alias("b"))
                      for n, t in sorted(templates.items())])
    size = lambda t: F.size(t["b"])
    near = F.filter(known, lambda t: (200 * F.least(F.size("b"), size(t)) >= percent * (F.size("b") + size(t))))
    scored = F.transform(near, lambda t: F.struct(
        (F.size(F.array_intersect("b", t["b"])) * 2.0 / (F.size("b") + size(t))).alias("dice"), t["licence"].alias("licence")))
    best = F.array_sort(scored, lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1)
                        .when(x["licence"] < y["licence"], -1).otherwise(1))
    found = sets.select("id", "scope", "part", F.get(best, F.lit(0)).alias("best")).where(F.col("best.dice") * 100 >= percent)
    return found.select(F.col("id").alias(id_col), "scope", "part", "best.licence", "best.dice")
